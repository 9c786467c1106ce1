"""A cache of lookups: keys that have been asked before are not asked again.

Answers lie in versions, each a Parquet folder that is written once. A run reads them all, asks only for the keys that none of
them has, and adds what it got as a new version; a compaction writes one version of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved


class LookupCache:
    """Answers by key in a folder that all machines share, for one writer at a time. schema: the answer's columns, without the key and `version`."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = f"{key} string, {schema}, version int"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that were written to the end, from the last compaction on."""
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        done = sorted((int(n.split("-")[1]), n.startswith("all-")) for n in names if n.startswith(("all-", "new-")) and self._files.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))
        from_ = max((v for v, whole in done if whole), default=0)
        return [v for v, _ in done if v >= from_]

    def _folder_of(self, version: int) -> str:
        whole = f"{self.folder}/all-{version:06d}"
        return whole if self._files.exists(self._path(f"{whole}/_SUCCESS")) else f"{self.folder}/new-{version:06d}"

    def answers(self) -> DataFrame:
        """(key, answer's columns, version) of everything that is known."""
        found = [self._folder_of(v) for v in self.versions()]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def look_up(self, keys: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """The answers to all keys of `keys`, once each, and how many had to be asked.

        ask: a table (key) of distinct keys -> (key, answer's columns), at most a row a key; what it leaves out is not kept and is
        asked again. Null keys are not asked.
        """
        wanted = saved(keys.select(F.col(self.key).cast("string")).where(F.col(self.key).isNotNull()).distinct(), "wanted")
        unknown = saved(wanted.join(self.answers().select(self.key).hint("merge"), self.key, "left_anti"), "unknown")
        asked = unknown.count()
        if asked:
            version = max(self.versions(), default=0) + 1
            told = ask(unknown).withColumn("version", F.lit(version))
            told.select(*(F.col(c.split()[0]) for c in self.schema.split(", "))).write.mode("overwrite").parquet(f"{self.folder}/new-{version:06d}")
        return self.answers().join(wanted.hint("merge"), self.key, "left_semi"), asked

    def compact(self) -> int:
        """All versions as one, which readers then start from; the older ones are deleted. The number of the version."""
        old = self.versions()
        if len(old) < 2:
            return old[0] if old else 0
        version, before = max(old) + 1, [self._folder_of(v) for v in old]
        self.answers().repartition(self.key).write.mode("overwrite").parquet(f"{self.folder}/all-{version:06d}")
        for folder in before:
            self._files.delete(self._path(folder), True)
        return version
