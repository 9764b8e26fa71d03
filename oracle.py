"""The same queries as `linewright.plans.catalog`, written independently in DuckDB SQL.

RE2 has no look-around, so the path, float and integer rules are restated with a captured
neighbour or over a token list; pair scores and pair examples are brute-force self joins.
The event lines are ASCII, where RE2's classes equal the engine's. For document lines, words of any script are
put between two marks, which stand for the Unicode word boundary that RE2 lacks.
"""

from __future__ import annotations

_LEVEL = """case event_type when 'error' then 'ERROR ' when 'purchase' then 'INFO '
    when 'signup' then 'WARNING ' when 'click' then 'DEBUG ' else '' end"""
_COMPONENT = "case when event_type = 'view' then '' else '[' || event_type || '] ' end"

_EV = f"""ev as (
select event_id, event_type, user_id, event_id + 1 as line_number,
  '/logs/' || event_type || '_node' || (user_id % 8) || case when event_type = 'view' then '.txt' else '.log' end as file_path,
  event_type || '_node' || (user_id % 8) || '_' || (event_id // 16777216) as log,
  case when event_id % 11 = 5 then null else event_type || '_' || (user_id % 3) end as expected_group_id,
  case when event_id % 4 = 1 then null else
    '<INT>-<INT>-<INT> <INT>:<INT>:<INT> ' || {_LEVEL} || {_COMPONENT} || 'user <INT> '
    || case when event_id % 3 = 1 then '<VAR>' else 'node' || (user_id % 8) end
    || ' from <IP> took <DURATION> amount <FLOAT> delta <INT> open <PATH> addr <HEX> request_id='
    || case when event_id % 3 = 1 then '<id>' else '<ID>' end end as expected_template,
  case when event_id % 97 = 13 then ' ' || chr(9) || ' ' else
    case when event_id % 7 = 0 then chr(9) || ' ' else '' end
    || case event_id % 5 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ ') when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S,%g ')
         when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S ') when 3 then strftime(ts, '%b %d %H:%M:%S ') else '' end
    || {_LEVEL} || {_COMPONENT} || 'user ' || user_id || ' node' || (user_id % 8)
    || ' from 10.0.' || (user_id % 256) || '.' || (event_id % 256) || ' took ' || (event_id % 5000)
    || ' ms amount ' || cast(cast(value as decimal(12,2)) as varchar) || ' delta -' || (event_id % 10)
    || ' open /var/log/u' || user_id || '/run.log addr 0x' || lower(hex(event_id + 4096))
    || ' request_id=req' || lpad(cast(event_id as varchar), 12, '0')
    || case when event_id % 3 = 0 then ' uuid ' || md5(cast(event_id as varchar))[1:8] || '-' || md5(cast(event_id as varchar))[9:12]
         || '-' || md5(cast(event_id as varchar))[13:16] || '-' || md5(cast(event_id as varchar))[17:20] || '-'
         || md5(cast(event_id as varchar))[21:32] else '' end
    || case when event_id % 7 = 1 then '  ' else '' end
  end as value
from events),
tx as (select *, event_id + 1 as idx, trim(value, ' ' || chr(9)) as raw_text from ev where trim(value, ' ' || chr(9)) <> '')"""

# Rule -> (pattern, replacement) usable by RE2 as they stand, in rule order
_IP = (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>")
_UUID = (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>")
_HEX = (r"\b0x[0-9a-fA-F]+\b", "<HEX>")
_DURATION = (r"\b\d+(?:\.\d+)?\s?(?:ms|s|sec|secs|seconds|m|min|mins|minutes|h|hr|hrs|hours)\b", "<DURATION>")
_PATH = (r"(^|[^\w])/[\w.\-/]+", r"\1<PATH>")
_LONG_ID = (r"\b[A-Za-z0-9][A-Za-z0-9_-]{11,}\b", "<ID>")
_FLOAT = (r"\d+\.\d+", "<FLOAT>")
_INT = (r"\d+", "<INT>")

_TOKENS = r"regexp_extract_all({t}, '[\w.]+|[^\w.]')"


def _plain(t: str, rule: tuple[str, str]) -> tuple[str, str]:
    pattern, replacement = rule
    return (
        f"regexp_replace({t}, '{pattern}', '{replacement}', 'g')",
        f"len(regexp_extract_all({t}, '{pattern}'))",
    )


def _numeric(k: str, rule: tuple[str, str]) -> tuple[str, str]:
    """A signed number standing alone, over the token list `k`."""
    pattern, replacement = rule
    text = f"""coalesce(array_to_string(list_transform(range(1, len({k}) + 1), lambda j:
      case when regexp_full_match({k}[j], '{pattern}') then '{replacement}'
           when {k}[j] in ('+', '-') and j < len({k}) and regexp_full_match({k}[j + 1], '{pattern}')
                and (j = 1 or not regexp_matches({k}[j - 1], '[\\w\\p{{L}}\\p{{N}}.]')) then ''
           else {k}[j] end), ''), '')"""
    return text, f"len(list_filter({k}, lambda x: regexp_full_match(x, '{pattern}')))"


def _steps(base: str) -> str:
    """CTEs n1..n8 applying the rules in order to `raw_text` of `base`; n8 is `norm`."""
    steps = []
    previous, column = base, "raw_text"
    for number, rule in enumerate((_IP, _UUID, _HEX, _DURATION, _PATH), 1):
        text, count = _plain(column, rule)
        steps.append(f"n{number} as (select *, {text} as t{number}, {count} as c{number} from {previous})")
        previous, column = f"n{number}", f"t{number}"
    steps.append(f"k6 as (select *, {_TOKENS.format(t='t5')} as kk6 from n5)")
    text, count = _numeric("kk6", _FLOAT)
    steps.append(f"n6 as (select *, {text} as t6, {count} as c6 from k6)")
    text, count = _plain("t6", _LONG_ID)
    steps.append(f"n7 as (select *, {text} as t7, {count} as c7 from n6)")
    steps.append(f"k8 as (select *, {_TOKENS.format(t='t7')} as kk8 from n7)")
    text, count = _numeric("kk8", _INT)
    steps.append(f"norm as materialized (select *, {text} as normalized_text, {count} as c8 from k8)")
    return ",\n".join(steps)


# A word character of any script, and the rules over text whose words stand between the marks \x01 and \x02.
_W = r"\p{L}\p{N}_"
_HEXES = "[0-9a-fA-F]"
_MARKED = (
    (r"\x01(?:\p{Nd}{1,3}\x02\.\x01){3}\p{Nd}{1,3}\x02", "<IP>"),
    (r"\x02-\x01".join([r"\x01" + _HEXES + "{8}", *[_HEXES + "{4}"] * 3, _HEXES + r"{12}\x02"]), "<UUID>"),
    (r"\x010x" + _HEXES + r"+\x02", "<HEX>"),
    (
        r"\x01\p{Nd}+(?:\x02\.\x01\p{Nd}+)?(?:\x02[\s\x0b\x1c-\x1f\x{85}\p{Z}]\x01)?"
        r"(?:ms|s|sec|secs|seconds|m|min|mins|minutes|h|hr|hrs|hours)\x02",
        "<DURATION>",
    ),
    (rf"(^|[^\x02])/[\x01\x02{_W}.\-/]+", r"\1<PATH>"),
)
# An end before a word that the class does not hold takes that word's mark with it: no later match could begin there.
_MARKED_ID = (r"\x01[A-Za-z0-9](?:[\x01\x02]?[A-Za-z0-9_-]){11,}[\x01\x02]", "<ID>")


def _unicode_tokens(t: str) -> str:
    return f"regexp_extract_all({t}, '[{_W}.]+|[^{_W}.]')"


def _marked(t: str, rule: tuple[str, str]) -> tuple[str, str]:
    text, count = _plain(f"regexp_replace({t}, '([{_W}]+)', chr(1) || '\\1' || chr(2), 'g')", rule)
    return f"translate({text}, chr(1) || chr(2), '')", count


def _unicode_steps(base: str) -> str:
    """The CTEs of `_steps` for text of any script."""
    steps = []
    previous, column = base, "raw_text"
    for number, rule in enumerate(_MARKED, 1):
        text, count = _marked(column, rule)
        steps.append(f"n{number} as (select *, {text} as t{number}, {count} as c{number} from {previous})")
        previous, column = f"n{number}", f"t{number}"
    steps.append(f"k6 as (select *, {_unicode_tokens('t5')} as kk6 from n5)")
    text, count = _numeric("kk6", (r"\p{Nd}+\.\p{Nd}+", "<FLOAT>"))
    steps.append(f"n6 as (select *, {text} as t6, {count} as c6 from k6)")
    text, count = _marked("t6", _MARKED_ID)
    steps.append(f"n7 as (select *, {text} as t7, {count} as c7 from n6)")
    steps.append(f"k8 as (select *, {_unicode_tokens('t7')} as kk8 from n7)")
    text, count = _numeric("kk8", (r"\p{Nd}+", "<INT>"))
    steps.append(f"norm as materialized (select *, {text} as normalized_text, {count} as c8 from k8)")
    return ",\n".join(steps)


_NAMES = ("ip_address", "uuid", "hex_value", "duration", "file_path", "float_value", "long_id", "integer")

_SIGNATURE = r"""array_to_string(list_transform(regexp_split_to_array(normalized_text, '\s+'), lambda w:
    case when trim(w, ',;') like '<%>' then trim(w, ',;')
         when trim(w, ',;') like '[%]' then lower(trim(w, ',;'))
         when upper(trim(w, ',;')) in ('DEBUG', 'INFO', 'WARN', 'WARNING', 'ERROR', 'CRITICAL', 'FATAL') then upper(trim(w, ',;'))
         when regexp_matches(w, '[0-9]') then '<VAR>'
         else lower(trim(w, ',;')) end), ' ')"""

_TIMESTAMP = r"""case
  when regexp_matches(raw_text, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z') then
    try_cast(replace(regexp_extract(raw_text, '^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?)Z', 1), 'T', ' ') as timestamp)
  when regexp_matches(raw_text, '^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}') then
    try_strptime(raw_text[1:23], '%Y-%m-%d %H:%M:%S,%g')
  when regexp_matches(raw_text, '^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d') then try_strptime(raw_text[1:19], '%Y-%m-%d %H:%M:%S')
  when regexp_matches(raw_text, '^[A-Z][a-z]{2} \d\d \d\d:\d\d:\d\d') then
    try_strptime('2024 ' || raw_text[1:15], '%Y %b %d %H:%M:%S') end"""
_SEVERITY = r"nullif(regexp_extract(raw_text, '\b(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b', 1), '')"
_BRACKET = r"nullif(regexp_extract(raw_text, '\[([A-Za-z0-9_.-]+)\]', 1), '')"
_STEM = r"regexp_replace(regexp_extract(file_path, '[^/]+$'), '(.)\.[^.]+$', '\1')"
_NAME = r"^([a-zA-Z][a-zA-Z0-9-]*?)(?:[_-]([a-zA-Z]+[a-zA-Z0-9-]*\d+))?$"
_SOURCE = f"nullif(regexp_extract({_STEM}, '{_NAME}', 1), '')"
_HOST = f"nullif(regexp_extract({_STEM}, '{_NAME}', 2), '')"


def _identity(job: str) -> str:
    return f"sha256('{job}' || chr(0) || file_path || chr(0) || cast(line_number as varchar))"


_NORM = f"with {_EV},\n{_steps('tx')}"

# Labelled predictions of both methods; group ids follow the first index of a template.
_PRED = f"""{_NORM},
both_methods as (
  select 'normalized_identity' as method, idx, raw_text, expected_group_id, expected_template, normalized_text as predicted_template from norm
  union all
  select 'token_pattern', idx, raw_text, expected_group_id, expected_template, {_SIGNATURE} from norm),
firsts as (select method, predicted_template, min(idx) as first_index from both_methods group by all),
ranked as (select *, row_number() over (partition by method order by first_index) as r from firsts),
pred as materialized (
  select b.*, r, 'group_' || case when r < 1000 then lpad(cast(r as varchar), 3, '0') else cast(r as varchar) end as predicted_group_id
  from both_methods b join ranked using (method, predicted_template))"""

# Labelled rows with labels as small integers, for brute force over all pairs.
_PAIRS = f"""{_PRED},
small as materialized (
  select method, idx, r, dense_rank() over (order by expected_group_id) as e, expected_group_id, predicted_group_id, raw_text
  from pred where expected_group_id is not null)"""

_PAIR_METRICS = """select a.method,
    cast(count(*) as double) as total,
    sum(case when a.e = b.e and a.r <> b.r then 1 else 0 end) as split,
    sum(case when a.e <> b.e and a.r = b.r then 1 else 0 end) as merged
  from small a join small b on a.method = b.method and a.idx < b.idx group by a.method"""

_TEMPLATE_METRICS = """select method, count(distinct predicted_template) as predicted_template_count,
    nullif(count(distinct expected_template), 0) as expected_template_count,
    avg(case when expected_template is null then null when expected_template = predicted_template then 1.0 else 0.0 end) as exact_template_match_rate,
    count(case when expected_group_id is not null or expected_template is not null then 1 end) as labelled_lines
  from pred group by method"""


def _pair_examples(agree: str, differ: str, shown: str) -> str:
    return f"""{_PAIRS}
select method, left_index, right_index, left_text, right_text, {shown} from (
  select a.method, a.idx as left_index, b.idx as right_index, a.raw_text as left_text, b.raw_text as right_text, a.{shown},
    row_number() over (partition by a.method order by a.idx, b.idx) as place
  from small a join small b on a.method = b.method and a.{agree} = b.{agree} and a.{differ} <> b.{differ} and a.idx < b.idx)
where place <= 5"""


def _single_rule(rule: tuple[str, str]) -> str:
    return f"with {_EV} select event_id, {_plain('raw_text', rule)[0]} as normalized_text from tx"


def _single_numeric(rule: tuple[str, str]) -> str:
    return f"""with {_EV}, k as (select *, {_TOKENS.format(t='raw_text')} as kk from tx)
select event_id, {_numeric('kk', rule)[0]} as normalized_text from k"""


def _json_counts(pairs: list[tuple[str, str]]) -> str:
    entries = ", ".join(f"case when {count} > 0 then '\"{name}\":' || ({count}) end" for name, count in pairs)
    return f"'{{' || array_to_string(list_filter([{entries}], lambda x: x is not null), ',') || '}}'"


def _one_method(method: str) -> str:
    return f"""{_PRED}
select idx as index, predicted_group_id, predicted_template from pred where method = '{method}'"""


# Text of every white-space character, for stripping lines of any script.
_SPACES = " || ".join(f"chr({i})" for i in range(0x3001) if chr(i).isspace())

_DOC_LINES = f"""docs as (
  select doc_id, '/docs/' || source || '-doc' || doc_id || '.txt' as file_path,
    unnest(parts) as value, unnest(range(1, len(parts) + 1)) as line_number
  from (select *, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as parts from documents)),
dx as (select *, trim(value, {_SPACES}) as raw_text from docs where trim(value, {_SPACES}) <> '')"""

_DOC_NORM = f"with {_DOC_LINES},\n{_unicode_steps('dx')}"


def _perturb() -> str:
    """Rebuild each line from its parts and digest-made tokens, one token class at a time."""
    number = "cast('0x' || d[1:15] as bigint)"
    ip = " || '.' || ".join(f"(({number} >> {12 * i}) % 254 + 1)" for i in range(4))
    uuid = "d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32]"
    duration = f"({number} % 4996 + 5) || ' ' || regexp_replace(f, '[^A-Za-z]', '', 'g')"
    long_id = "d[1:16]"
    steps = []
    previous, column = "keyed", "raw_text"
    for n, (name, (pattern, _), token) in enumerate(
        (("ip_address", _IP, ip), ("uuid", _UUID, uuid), ("duration", _DURATION, duration), ("long_id", _LONG_ID, long_id))
    ):
        body = token.replace("d[", f"sha256(key || '|{name}|' || (i - 1))[").replace("(f,", f"(found{n}[i],")
        steps.append(
            f"""a{n} as (select *, regexp_extract_all({column}, '{pattern}') as found{n},
              regexp_split_to_array({column}, '{pattern}') as parts{n} from {previous}),
            p{n} as (select *, parts{n}[1] || array_to_string(list_transform(range(1, len(found{n}) + 1),
              lambda i: {body} || parts{n}[i + 1]), '') as x{n} from a{n})"""
        )
        previous, column = f"p{n}", f"x{n}"
    return ",\n".join(steps) + f",\nperturbed as materialized (select *, {column} as changed_text from {previous})"


_KEYED = "keyed as (select *, sha256('7|' || idx || '|' || raw_text) as key from tx)"
_PERTURBED = f"with {_EV}, {_KEYED}, {_perturb()}"

_CUSTOM_STEPS = r"""k1 as (select * replace (chr(27) || '[31m' || raw_text || chr(27) || '[0m' as raw_text) from tx),
k2 as (select *, regexp_replace(raw_text, '\x1b\[[0-9;]*m', '', 'g') as b1, len(regexp_extract_all(raw_text, '\x1b\[[0-9;]*m')) as d1 from k1),
k3 as (select *, regexp_replace(b1, '\[error]\b|\[[a-z]+\]', '[<KIND>]', 'g') as b2, len(regexp_extract_all(b1, '\[error]\b|\[[a-z]+\]')) as d2 from k2),
u1 as (select *, regexp_replace(b2, '(\w+)=\w+', '\1=<VALUE>', 'g') as a1, len(regexp_extract_all(b2, '(\w+)=\w+')) as c1 from k3),
u2 as (select *, regexp_replace(a1, '\b\d+\s?ms\b', '<MS>', 'g') as a2, len(regexp_extract_all(a1, '\b\d+\s?ms\b')) as c2 from u1),
u3 as (select *, regexp_replace(a2, '\bnode\d+\b', '<NODE>', 'g') as a3, len(regexp_extract_all(a2, '\bnode\d+\b')) as c3 from u2),
u4 as (select *, regexp_replace(a3, '\buser \d+\b', '$USER', 'g') as a4, len(regexp_extract_all(a3, '\buser \d+\b')) as c4 from u3)"""

_LABELS = "select event_id + 1 as idx, file_path as file, line_number, expected_group_id, expected_template from ev"

ORACLE: dict[str, str] = {
    "top_templates": f"""{_NORM}
select normalized_text as template, count(*) as lines, min(idx) as first_index from norm
group by 1 order by lines desc, first_index limit 20""",
    "line_numbers": f"with {_EV} select log, row_number() over (partition by log order by event_id) as line_number, value from ev",
    "discover_files": f"with {_EV} select log, count(distinct log) as files, sum(strlen(value) + 1)::bigint as bytes from ev group by log",
    "relative_paths": f"with {_EV} select 'log=' || log as folder, count(*) as lines from ev group by log",
    "dispatch": f"""with {_EV} select kind, count(*) as records, count(*) as last_index
from tx cross join (select unnest(['local', 'synthetic']) as kind) group by kind""",
    "rules_from_file": f"{_NORM} select event_id, normalized_text from norm",
    "table_versions": f"""with {_EV}, n as (select count(*) as n from tx)
select s.step, s.version::int as version, case when s.version = 0 then 0 else n end as rows, case when s.version = 0 then 0 else n end as ids
from n cross join (values ('made', 0), ('made again', 0), ('filled', 1), ('filled again', 2), ('partly replaced', 3)) as s(step, version)""",
    "log_records": f"""{_NORM}
select {_identity('events')} as id, {_TIMESTAMP} as timestamp, {_SOURCE} as source, {_HOST} as host, 'events' as job_id,
  {_SEVERITY} as severity, {_BRACKET} as component, raw_text, normalized_text, file_path, line_number from norm""",
    "document_records": f"""with {_DOC_LINES}
select {_identity('documents')} as id, {_TIMESTAMP} as timestamp, {_SOURCE} as source, {_HOST} as host, 'documents' as job_id,
  {_SEVERITY} as severity, {_BRACKET} as component, raw_text, file_path, line_number from dx""",
    "eval_local": f"""with {_EV},
kept as (select row_number() over (order by event_id) as index, value as raw_text from tx),
lab as (select event_id + 1 as index, case when expected_group_id is null then case when (event_id + 1) % 5 = 0 then '2' else '1' end
    else expected_group_id || case when (event_id + 1) % 5 = 0 then '#2' else '#1' end end as expected_group_id,
  expected_template from ev)
select index, raw_text, lab.expected_group_id, lab.expected_template from kept left join lab using (index)""",
    "eval_synthetic": f"""with {_EV},
placed as (select *, row_number() over (partition by log order by event_id) as number from ev),
kept as (select * from placed where trim(value, ' ' || chr(9)) <> '')
select row_number() over (order by 'log=' || log, number) as index, trim(value, ' ' || chr(9)) as raw_text, log, number as line_number,
  expected_template, expected_group_id from kept""",
    "strip_lines": f"with {_EV} select event_id, raw_text from tx",
    "strip_document_lines": f"with {_DOC_LINES} select doc_id, line_number, raw_text from dx",
    "parse_timestamp": f"with {_EV} select event_id, {_TIMESTAMP} as timestamp from tx",
    "severity": f"with {_EV} select event_id, {_SEVERITY} as severity from tx",
    "component": f"with {_EV} select event_id, {_BRACKET} as component from tx",
    "source_host": f"with {_EV} select event_id, {_SOURCE} as source, {_HOST} as host from ev",
    "record_ids": f"with {_EV} select event_id, {_identity('events')} as id, 'events' as job_id from ev",
    "normalize": f"{_NORM} select event_id, normalized_text from norm",
    "normalize_trace": f"""{_NORM}
select event_id, normalized_text, normalized_text <> raw_text as changed,
  {_json_counts([(name, f'c{i}') for i, name in enumerate(_NAMES, 1)])} as replacement_counts from norm""",
    "normalize_documents": f"""{_DOC_NORM}
select file_path, line_number, normalized_text, normalized_text <> raw_text as changed,
  {_json_counts([(name, f'c{i}') for i, name in enumerate(_NAMES, 1)])} as replacement_counts from norm""",
    "document_templates": f"""{_DOC_NORM}, signed as (select {_SIGNATURE} as template, file_path, line_number from norm)
select template, count(*) as lines, (min((file_path, line_number)))[1] as first_file, (min((file_path, line_number)))[2] as first_line
from signed group by template""",
    "rule_ip": _single_rule(_IP),
    "rule_uuid": _single_rule(_UUID),
    "rule_hex": _single_rule(_HEX),
    "rule_duration": _single_rule(_DURATION),
    "rule_path": _single_rule(_PATH),
    "rule_float": _single_numeric(_FLOAT),
    "rule_long_id": _single_rule(_LONG_ID),
    "rule_int": _single_numeric(_INT),
    "normalize_custom": f"""with {_EV}, {_CUSTOM_STEPS}
select event_id, a4 as normalized_text, a4 <> raw_text as changed,
  {_json_counts([('colour', 'd1'), ('bracket', 'd2'), ('key_value', 'c1'), ('unit', 'c2'), ('node', 'c3 + c4')])} as replacement_counts from u4""",
    "token_signature": f"{_NORM} select event_id, {_SIGNATURE} as signature from norm",
    "group_identity": _one_method("normalized_identity"),
    "group_token_pattern": _one_method("token_pattern"),
    "group_all_methods": f"{_PRED} select method, idx as index, predicted_group_id, predicted_template from pred",
    "template_counts": f"""{_NORM}
select normalized_text as template, count(*) as lines, min(idx) as first_index from norm group by 1""",
    "join_labels_index": f"with {_EV} select idx as index, raw_text, expected_group_id, expected_template from tx",
    "join_labels_file_line": f"""with {_EV}
select file_path as file, line_number, value, expected_group_id, expected_template from ev""",
    "join_predictions": f"""{_PRED}
select idx as index, raw_text, expected_group_id, expected_template, predicted_group_id, predicted_template
from pred where method = 'token_pattern'""",
    "norm_metrics": f"""{_NORM}
select count(*) as total_lines, count(case when normalized_text <> raw_text then 1 end) as changed_lines,
  count(case when normalized_text <> raw_text then 1 end) / count(*) * 100.0 as percent_changed from norm""",
    "rule_counts": f"""{_NORM}, sums as (select {', '.join(f'cast(sum(c{i}) as bigint) as c{i}' for i in range(1, 9))} from norm)
{' union all '.join(f"select '{name}' as rule, c{i} as replacements from sums where c{i} > 0" for i, name in enumerate(_NAMES, 1))}""",
    "changed_examples": f"""{_NORM}
select idx as index, raw_text, normalized_text from norm where raw_text <> normalized_text order by idx limit 5""",
    "grouping_metrics": f"{_PRED} {_TEMPLATE_METRICS}",
    "pair_metrics": f"""{_PAIRS}
select method, (total - split - merged) / total as grouping_pair_accuracy,
  cast(split as decimal(38,0)) as over_splitting_pairs, cast(merged as decimal(38,0)) as over_merging_pairs
from ({_PAIR_METRICS})""",
    "template_mismatches": f"""{_PRED}
select method, idx as index, raw_text, expected_template, predicted_template from pred
where expected_template <> predicted_template
qualify row_number() over (partition by method order by idx) <= 5""",
    "false_splits": _pair_examples("e", "r", "expected_group_id"),
    "false_merges": _pair_examples("r", "e", "predicted_group_id"),
    "failure_patterns": f"""{_PRED},
wrong as (select method, expected_template, predicted_template, count(*) as n, min(idx) as first_index from pred
  where expected_template <> predicted_template group by all)
select method, 'template_mismatch::' || expected_template || ' -> ' || predicted_template as pattern, n as count from wrong
qualify row_number() over (partition by method order by n desc, first_index) <= 5""",
    "perturb": f"{_PERTURBED} select idx as index, changed_text as raw_text from perturbed",
    "perturbed_groups": f"""{_PERTURBED}, fresh as (select expected_group_id, changed_text as raw_text from perturbed),
{_steps('fresh')}
select expected_group_id, normalized_text as template, count(*) as lines from norm group by all""",
    "upsert_latest": f"""{_NORM}
select {_identity('events')} as id, {_SEVERITY} as severity, raw_text,
  case when {_SEVERITY} = 'ERROR' then normalized_text end as normalized_text from norm""",
    "inspect_records": f"""{_NORM}
select {_SOURCE} as source, {_HOST} as host, 'events' as job_id, raw_text, normalized_text from norm
order by file_path, line_number limit 10""",
    "ingest_summary": f"""with {_EV}
select count(distinct log) as files_processed, count(case when trim(value, ' ' || chr(9)) <> '' then 1 end) as log_lines_ingested,
  count(case when trim(value, ' ' || chr(9)) <> '' then 1 end) as records_written from ev""",
    "benchmark_summary": f"""{_PAIRS}, pm as ({_PAIR_METRICS}), tm as ({_TEMPLATE_METRICS}),
nm as (select count(*) as total_lines, count(case when normalized_text <> raw_text then 1 end) as changed_lines from norm)
select method, total_lines, changed_lines, changed_lines / total_lines * 100.0 as percent_changed,
  predicted_template_count, expected_template_count, exact_template_match_rate, labelled_lines,
  (total - split - merged) / total as grouping_pair_accuracy,
  cast(split as decimal(38,0)) as over_splitting_pairs, cast(merged as decimal(38,0)) as over_merging_pairs
from tm join pm using (method) cross join nm""",
}

ORACLE["eval_local_file"] = ORACLE["eval_local"]

_STORED = {
    "summary": "benchmark_summary",
    "rule_counts": "rule_counts",
    "changed_examples": "changed_examples",
    "template_mismatches": "template_mismatches",
    "false_splits": "false_splits",
    "false_merges": "false_merges",
    "failure_patterns": "failure_patterns",
    "predictions": "group_all_methods",
}
ORACLE["stored_evaluation"] = " union all ".join(
    f"select '{table}' as result_table, '20300102T030405Z_events' as run_id, count(*) as rows from ({ORACLE[query]})"
    for table, query in _STORED.items()
)
