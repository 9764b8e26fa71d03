"""Rewrite Python regular expressions as Java ones with the same meaning.

Python patterns are Unicode-aware by default, Java's are not, and a few escapes differ.
Two forms exist: the full one, and a faster one for text known to be ASCII, where Java's
own `\\w`, `\\d` and `\\b` already agree with Python's.

The engines also differ in where they look next after matching the empty text, so a rule
should match at least one character; rules that do agree everywhere.
"""

from __future__ import annotations

import re

# Members of Python's \w and \s, written for use inside a Java character class.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_NO_BOUNDARY = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"

# Java steps and looks behind by code point only if a pattern contains a character beyond
# the BMP. This ending contains one and always matches the empty text first.
_BY_CODE_POINT = "(?:|\U00010000)"

# escape -> (outside a class, inside a class)
_UNICODE = {
    "w": (f"[{WORD}]", WORD),
    "W": (f"[^{WORD}]", f"[^{WORD}]"),
    "d": (r"\p{Nd}", r"\p{Nd}"),
    "D": (r"\P{Nd}", r"\P{Nd}"),
    "s": (f"[{SPACE}]", SPACE),
    "S": (f"[^{SPACE}]", f"[^{SPACE}]"),
    "b": (_BOUNDARY, r"\x08"),
    "B": (_NO_BOUNDARY, ""),
}
_ASCII = {
    "w": (r"\w", r"\w"),
    "W": (r"\W", r"\W"),
    "d": (r"\d", r"\d"),
    "D": (r"\D", r"\D"),
    "s": (r"[\s\x1c-\x1f]", r"\s\x1c-\x1f"),
    "S": (r"[^\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"),
    "b": (r"\b", r"\x08"),
    "B": (r"\B", ""),
}
_SHARED = {"v": (r"\x0b", r"\x0b"), "Z": (r"\z", "")}

# Outside a class, digits are an octal escape if they start with 0 or are three; else they name a group.
_OCTAL = re.compile(r"\\(0[0-7]{0,2}|[1-7][0-7]{2})")
_OCTAL_IN_CLASS = re.compile(r"\\([0-7]{1,3})")
_TOKEN = re.compile(
    r"""\\U(?P<wide>[0-9a-fA-F]{8})
      | (?P<code>\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4})
      | \\(?P<escape>.)
      | \(\?P<(?P<group>\w+)>
      | \(\?P=(?P<named_ref>\w+)\)
      | \(\?(?P<flags>[aiLmsux-]+)(?P<flags_end>[:)])
      | (?P<conditional>\(\?\()
      | (?P<comment>\(\?\#[^)]*\))
      | (?P<plain_group>\(\?:)
      | \{(?P<repeat>\d*,?\d*)\}
      | (?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)
# A class, as text, whose members all are ASCII word characters or \w and \d.
_WORD_CLASS = re.compile(r"\[(?:\\[wd]|[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]|[A-Za-z0-9_](?!-[^\]]))+\]")
_ANY_CLASS = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]", re.DOTALL)


def _atoms(pattern: str) -> list[tuple[int, str, bool]]:
    """(start, text, whether it surely matches one word character) of each atom, quantifier or mark."""
    out = []
    at = 0
    while at < len(pattern):
        if pattern[at] == "[":
            text = _ANY_CLASS.match(pattern, at).group(0)
            word = bool(_WORD_CLASS.fullmatch(text))
        else:
            token = _OCTAL.match(pattern, at) or _TOKEN.match(pattern, at)
            text = token.group(0)
            word = text in (r"\w", r"\d") or (text.isascii() and (text.isalnum() or text == "_"))
        out.append((at, text, word))
        at += len(text)
    return out


def _may_be_absent(text: str) -> bool:
    return text in ("?", "*") or text == "{}" or bool(re.match(r"\{(?:0|,)", text))


def _follows_word(atoms: list[tuple[int, str, bool]], i: int) -> bool:
    """Whether what stands before atom i surely ends in a word character."""
    i -= 1
    # A lazy or possessive sign, then the repeat itself.
    while i > 0 and (atoms[i][1] == "+" or re.fullmatch(r"\{[1-9]\d*(?:,\d*)?\}", atoms[i][1])):
        i -= 1
    return i >= 0 and atoms[i][2]


def _precedes_word(atoms: list[tuple[int, str, bool]], i: int) -> bool:
    """Whether what stands after atom i surely begins with a word character."""
    i += 1
    if i < len(atoms) and atoms[i][1] == "(?:":
        depth, end = 1, i + 1
        while end < len(atoms) and depth:
            text = atoms[end][1]
            if text == "|" and depth == 1:
                return False
            depth += text.startswith("(") and not text.endswith(")")
            depth -= text == ")"
            end += 1
        if end < len(atoms) and _may_be_absent(atoms[end][1]):
            return False
        i += 1
    if i >= len(atoms) or not atoms[i][2]:
        return False
    return i + 1 >= len(atoms) or not _may_be_absent(atoms[i + 1][1])


def _boundary(atoms: list[tuple[int, str, bool]], start: int) -> str:
    """Next to something that surely matches a word character, half of a boundary is enough."""
    i = next(k for k, atom in enumerate(atoms) if atom[0] == start)
    if _precedes_word(atoms, i):
        return f"(?<![{WORD}])"
    if _follows_word(atoms, i):
        return f"(?![{WORD}])"
    return _BOUNDARY


def _group_name(pattern: re.Pattern, name: str) -> str:
    return f"g{pattern.groupindex[name]}"


def to_java(pattern: str, ascii_text: bool = False) -> str:
    """Return a Java pattern equal to the Python `pattern`; ValueError if there is none."""
    compiled = re.compile(pattern)
    escapes = {**(_ASCII if ascii_text else _UNICODE), **_SHARED}
    out: list[str] = []
    in_class = negated = False
    class_start = -1  # index in `out` where the members of the open class begin
    atoms = _atoms(pattern)
    at = 0
    while at < len(pattern):
        octal = (_OCTAL_IN_CLASS if in_class else _OCTAL).match(pattern, at)
        if octal:
            out.append(rf"\x{int(octal[1], 8):02x}")
            at = octal.end()
            continue
        token = _TOKEN.match(pattern, at)
        at = token.end()
        text = token.group(0)
        escape = token["escape"]
        if token["wide"]:
            out.append(rf"\x{{{token['wide']}}}")
        elif token["code"]:
            out.append(text)
        elif escape in escapes:
            if in_class and negated and escape in "WDS":
                raise ValueError(f"negated class with \\{escape} has no safe Java form: {pattern}")
            if escape == "b" and not in_class and not ascii_text:
                out.append(_boundary(atoms, token.start()))
            else:
                out.append(escapes[escape][in_class])
        elif escape:
            out.append(text)
        elif in_class:
            if text == "]" and len(out) > class_start:
                in_class = False
                out.append(text)
            elif text == "^" and len(out) == class_start and not negated:
                negated = True
                out[-1] += "^"
            else:
                out.extend("\\" + c if c in "[]&^#" else c for c in text)
        elif text == "[":
            in_class, negated = True, False
            out.append(text)
            class_start = len(out)
        elif token["group"]:
            out.append(f"(?<{_group_name(compiled, token['group'])}>")
        elif token["named_ref"]:
            out.append(rf"\k<{_group_name(compiled, token['named_ref'])}>")
        elif token["flags"]:
            if set(token["flags"]) & set("aLx"):
                raise ValueError(f"inline flag has no Java form: {pattern}")
            flags = token["flags"].replace("u", "").replace("i", "iu")
            out.append(f"(?{flags}{token['flags_end']}" if flags else "")
        elif token["conditional"]:
            raise ValueError(f"conditional group has no Java form: {pattern}")
        elif token["comment"]:
            continue
        elif token["repeat"] is not None:
            low, comma, high = token["repeat"].partition(",")
            if not token["repeat"]:
                out.append(text.replace("{", r"\{"))
            else:
                out.append(f"{{{low or '0'}{comma}{high}}}")
        elif text == "{":
            out.append(r"\{")
        else:
            out.append(text)
    java = "".join(out)
    if not ascii_text:
        java += _BY_CODE_POINT
    # Only \n ends a line for Python's . ^ $
    return "(?d)" + java if re.search(r"[.^$]", pattern) else java


_TEMPLATE = re.compile(
    r"\\g<(?P<ref>\w+)>|\\(?P<octal>0[0-7]?[0-7]?|[1-3][0-7]{2})|\\(?P<number>[1-9]\d?)|\\(?P<escape>.)|(?P<plain>[^\\]+)", re.DOTALL
)
_TEMPLATE_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\"}


def to_java_replacement(template: str, pattern: str) -> str:
    """Return the Java replacement text equal to a Python substitution template."""
    compiled = re.compile(pattern)
    out: list[str] = []
    for part in _TEMPLATE.finditer(template):
        ref = part["ref"] or part["number"]
        if ref:
            number = int(ref) if ref.isdigit() else compiled.groupindex[ref]
            if number > compiled.groups:
                raise ValueError(f"replacement refers to a missing group: {template}")
            out.append(f"${number}")
            continue
        literal = chr(int(part["octal"], 8)) if part["octal"] else part["plain"]
        if literal is None:
            if part["escape"].isascii() and part["escape"].isalpha() and part["escape"] not in _TEMPLATE_ESCAPES:
                raise ValueError(f"unknown escape in replacement: {template}")
            literal = _TEMPLATE_ESCAPES.get(part["escape"], part[0])
        literal = re.sub(r"([\\$])", r"\\\1", literal)
        if literal[0].isdigit() and out and out[-1].startswith("$"):
            literal = "\\" + literal  # keep a digit from extending the group number
        out.append(literal)
    return "".join(out)
