"""The registry as a chain of versions.

A version is a snapshot folder and a small commit file that names it. A commit
file appears whole, under the next number, and only if no other writer took that
number; a reader takes the commit with the highest number. So a change is seen
whole or not at all, a reader keeps the version it began with, and of two
writers the second merges into what the first has written.

Every entry carries the time at which its flag last changed. Flags are merged by
that time, whoever sends them: the stream that finds a station unknown, a user
who enables it again, or a reload of the whole registry.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import registry as R
from ..schemas import REGISTRY
from . import files

FLAG_AT = "flag_at"
STORED = T.StructType([*REGISTRY.fields, T.StructField(FLAG_AT, T.TimestampType())])


@dataclass(frozen=True)
class Commit:
    """A version: its snapshot, how many entries it has and how many of them are valid.

    ``affected`` is the number of entries that were named by the change, ``tag`` names the change.
    """

    version: int
    snapshot: str
    entries: int
    valid: int
    affected: int
    tag: str | None


class RegistryStore:
    """A versioned registry below one folder of a file system that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _commit_file(self, version: int) -> str:
        return f"{self.root}/commits/{version:020d}.json"

    def versions(self) -> list[int]:
        found = files.names(self.spark, f"{self.root}/commits")
        return [int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n[0] != "."]

    def commit(self, version: int | None = None) -> Commit:
        """What is known of a version, the newest if none is named."""
        if version is None:
            versions = self.versions()
            if not versions:
                raise LookupError(f"no registry at {self.root}")
            version = versions[-1]
        return Commit(**json.loads(files.read(self.spark, self._commit_file(version))))

    def read(self, version: int | None = None) -> DataFrame:
        """A version's entries, with ``flag_at``; later changes do not reach the result."""
        return self.spark.read.schema(STORED).parquet(f"{self.root}/{self.commit(version).snapshot}")

    def pin(self, name: str) -> int:
        """The version that goes by this name: the newest one at the first call, the same ever after.

        A micro-batch that is repeated thus reads what it read before.
        """
        path = f"{self.root}/pins/{name}"
        if not files.exists(self.spark, path):
            files.create(self.spark, path, str(self.commit().version))
        return int(files.read(self.spark, path))

    def create(self, registry: DataFrame) -> Commit:
        """Version 0. Without a ``flag_at`` column a flag is as old as its entry."""
        if self.versions():
            raise ValueError(f"there is a registry at {self.root}")
        return self._publish(lambda _: _stored(registry, "created_at"), None, None, -1)

    def change(self, changes: DataFrame, tag: str | None = None, at: dt.datetime | None = None) -> Commit:
        """Sets the flags of named entries: ``changes`` has (name, valid_entry) and may have ``flag_at``.

        Names that are not in the registry are left out. A change with the ``tag`` of an earlier one
        is not made again; the earlier commit is returned.
        """
        if FLAG_AT not in changes.columns:
            time = F.lit(at or dt.datetime.now(dt.timezone.utc)).cast("timestamp")
            changes = changes.withColumn(FLAG_AT, time)
        newest = R.newest_flags(changes)
        known = self.pin(f"change-{tag}") if tag else None
        return self._publish(lambda old: R.apply_flags(old, newest), newest, tag, known)

    def reload(self, registry: DataFrame, tag: str | None = None) -> Commit:
        """Takes over the rows of a whole registry. Flags are merged, the newest wins.

        An entry without ``flag_at`` takes the stored flag, if there is one.
        """
        known = self.pin(f"change-{tag}") if tag else None
        return self._publish(lambda old: R.merge_registry(old, _stored(registry, None)), None, tag, known)

    def expire(self, keep: int) -> int:
        """Removes the commits and snapshots of all but the newest ``keep`` versions; returns how many went."""
        old = self.versions()[: -max(keep, 1)]
        for version in old:
            snapshot = self.commit(version).snapshot
            for path in (self._commit_file(version), f"{self.root}/{snapshot}"):
                place, system = files._at(self.spark, path)
                system.delete(place, True)
        return len(old)

    def _publish(
        self, build: Callable[[DataFrame | None], DataFrame], changes: DataFrame | None, tag: str | None, known: int | None
    ) -> Commit:
        while True:
            versions = self.versions()
            last = versions[-1] if versions else -1
            if tag is not None:  # a change of this tag can only be newer than the version it was pinned to
                for version in versions:
                    if version > known and self.commit(version).tag == tag:
                        return self.commit(version)
            old = self.read(last) if versions else None
            snapshot = f"snapshots/{last + 1:020d}-{uuid.uuid4().hex}"
            counted = Observation()
            named = F.lit(False) if changes is None else F.col("_named")
            rows = build(old)
            if changes is not None:
                mark = changes.select("name", F.lit(True).alias("_mark"))
                rows = rows.join(mark, "name", "left").withColumn("_named", F.coalesce("_mark", F.lit(False)))
            rows.observe(
                counted,
                F.count(F.lit(1)).alias("entries"),
                F.count_if("valid_entry").alias("valid"),
                F.count_if(named).alias("affected"),
            ).select(*STORED.names).write.parquet(f"{self.root}/{snapshot}")
            commit = Commit(last + 1, snapshot, tag=tag, **counted.get)
            if files.create(self.spark, self._commit_file(last + 1), json.dumps(asdict(commit))):
                return commit


def _stored(registry: DataFrame, flag_at: str | None) -> DataFrame:
    if FLAG_AT not in registry.columns:
        time = F.col(flag_at) if flag_at else F.lit(None)
        registry = registry.withColumn(FLAG_AT, time.cast("timestamp"))
    return registry.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED.fields))
