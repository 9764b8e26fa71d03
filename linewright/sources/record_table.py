"""The record table: immutable Parquet parts and a manifest per version that names them; upserts by id.

A writer puts its part next to the others and publishes a manifest for the version after the one it read. The rename that
publishes fails if another writer was first; then only the search for replaced ids is done again. Readers take the newest manifest, so they see
a whole version before, while and after a write, and a writer that dies leaves the old one. Parts that no manifest of
interest names can be deleted like any old files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.labels import last_wins
from ..schemas import LOG_RECORD
from ..staging import scratch, stage
from . import hadoop

_COLUMNS = LOG_RECORD.fieldNames()
_DIGITS = 12
# A part is known by the last 32 hexadecimal digits of its folder: a name of its own, or that of the part which it replaces.
_KEY = 32
_REPLACES = "replaces"


def _part_key() -> Column:
    return F.regexp_extract("_metadata.file_path", f"([0-9a-f]{{{_KEY}}})/[^/]+$", 1)


@dataclass(frozen=True)
class Version:
    """A number and the parts of the table then: folder name -> key of the load that wrote it, or null."""

    number: int
    parts: dict[str, str | None]


class RecordTable:
    """Records below `path`: folders `parts/<name>` and files `manifests/<version>.json`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def create(self) -> None:
        """Create the table if it does not exist."""
        hadoop.make_dir(self.spark, f"{self.path}/manifests")

    def current(self) -> Version:
        names = [n for n in hadoop.children(self.spark, f"{self.path}/manifests") if n[:_DIGITS].isdigit() and n[_DIGITS:] == ".json"]
        if not names:
            return Version(0, {})
        newest = max(names)
        return Version(int(newest[:_DIGITS]), json.loads(hadoop.read_text(self.spark, f"{self.path}/manifests/{newest}")))

    def read(self, version: Version | None = None) -> DataFrame:
        return self._parts((version or self.current()).parts)

    def create_view(self, name: str = "log_records") -> None:
        """Make the table, as it is now, available to spark.sql."""
        self.read().createOrReplaceTempView(name)

    def inspect(self, limit: int = 10) -> DataFrame:
        """The first records in file and line order."""
        return first_records(self.read(), limit)

    def upsert(
        self, records: DataFrame, unique_ids: bool = False, scope: Column | None = None, new_ids: bool = False
    ) -> int:
        """Insert records, replacing stored ones of the same id; return how many came in.

        Incoming records are evaluated once, into their part. Parts that hold a replaced id are written again
        without it, the others stay as they are. If an id comes twice, the later row by (file_path, line_number) counts;
        `unique_ids` promises that none does. `scope` is a predicate that holds for all stored rows an incoming id can
        meet, such as one job: it reaches the Parquet scan. `new_ids` promises that no stored id comes again.
        """
        with scratch(self.spark):
            return self._upsert(records, unique_ids, scope, new_ids)

    def _upsert(self, records: DataFrame, unique_ids: bool, scope: Column | None, new_ids: bool) -> int:
        incoming = records.select(*_COLUMNS)
        came = None
        if not unique_ids:
            incoming = stage(incoming, "incoming")
            came = incoming.count()
            incoming = last_wins(incoming, ["id"], ["file_path", "line_number"]).select(*_COLUMNS)
        part = self._write(incoming)
        written = self._parts({part: None})
        if not new_ids:
            ids = written.select("id")
        count = written.count()
        if not count:
            return 0
        while True:
            base = self.current()
            parts = dict(base.parts) if new_ids else self._without(base, ids, scope)
            if self._publish(base, {**parts, part: None}):
                return count if came is None else came

    def replace_load(self, records: DataFrame, key: str) -> int:
        """Insert records as the load `key`, in place of what an earlier try of the same load wrote; nothing else is read.

        The caller promises that their ids are unique and not stored by other loads.
        """
        part = self._write(records.select(*_COLUMNS))
        while True:
            base = self.current()
            others = {name: load for name, load in base.parts.items() if load != key}
            if self._publish(base, {**others, part: key}):
                return self._parts({part: key}).count()

    def _without(self, base: Version, ids: DataFrame, scope: Column | None) -> dict[str, str | None]:
        """The parts of a version with the given ids taken out; all parts that hold one, and other rows, are written again by one job."""
        if not base.parts:
            return {}
        keys = {name[-_KEY:]: name for name in base.parts}
        stored = self._parts(base.parts).withColumn("_part", _part_key())
        candidates = stored if scope is None else stored.where(scope)
        met = stage(candidates.select("id", "_part").join(ids, "id", "left_semi"), "met")
        replaced = {keys[r["_part"]]: r["count"] for r in met.groupBy("_part").count().collect()}  # a row per load at most
        parts = {name: load for name, load in base.parts.items() if name not in replaced}
        held = self._parts(dict.fromkeys(replaced)).groupBy(_part_key().alias("_part")).count().collect() if replaced else []
        # Of a part whose rows are all replaced nothing is left to write.
        touched = [name for name, rows in ((keys[r["_part"]], r["count"]) for r in held) if rows > replaced[name]]
        if touched:
            rest = self._parts(dict.fromkeys(touched)).withColumn("_part", _part_key()).join(met, ["id", "_part"], "left_anti")
            again = uuid.uuid4().hex
            # Tasks get rows by part, large parts in several shares; rows of one part are dealt by their ids already.
            dealt = rest if len(touched) == 1 else rest.hint("rebalance", "_part")
            dealt.withColumnRenamed("_part", _REPLACES).write.partitionBy(_REPLACES).parquet(f"{self.path}/parts/{again}")
            for folder in hadoop.children(self.spark, f"{self.path}/parts/{again}"):
                if folder.startswith(f"{_REPLACES}="):
                    parts[f"{again}/{folder}"] = base.parts[keys[folder[-_KEY:]]]
        return parts

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/parts/{name}")
        return name

    def _publish(self, base: Version, parts: dict[str, str | None]) -> bool:
        """Make `parts` the version after `base`; False if that version exists by now."""
        draft = f"{self.path}/manifests/draft-{uuid.uuid4().hex}"
        hadoop.write_text(self.spark, draft, json.dumps(parts))
        return hadoop.publish(self.spark, draft, f"{self.path}/manifests/{base.number + 1:0{_DIGITS}d}.json")

    def _parts(self, parts: dict[str, str | None]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], LOG_RECORD)
        return self.spark.read.schema(LOG_RECORD).parquet(*(f"{self.path}/parts/{name}" for name in parts))


def first_records(records: DataFrame, limit: int = 10) -> DataFrame:
    return (
        records.orderBy("file_path", "line_number")
        .limit(limit)
        .select("source", "host", "job_id", "raw_text", "normalized_text")
    )
