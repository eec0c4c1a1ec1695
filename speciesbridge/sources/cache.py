"""A cache of trees."""

from __future__ import annotations

import json
import os
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TreeCache:
    """Trees by what was asked for: parquet below folder/source/key. A damaged entry is a miss."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @staticmethod
    def key(species: DataFrame, source: str, **asked: object) -> str:
        """The key of a set of names (the first column) and what else was asked; names stay where they are."""
        name = F.col(f"`{species.columns[0]}`")
        sums = [F.bit_xor(F.xxhash64(F.lit(i), name)).alias(f"h{i}") for i in (1, 2)]
        names = species.where(name.isNotNull()).select(name).distinct().agg(F.count("*").alias("n"), *sums).first()
        return sha1(json.dumps([list(names), source, sorted(asked.items(), key=lambda kv: kv[0])], ensure_ascii=False, default=str).encode()).hexdigest()

    def _path(self, source: str, key: str) -> str:
        return os.path.join(self.folder, source, key)

    def put(self, source: str, key: str, edges: DataFrame) -> None:
        edges.write.mode("overwrite").parquet(self._path(source, key))

    def get(self, source: str, key: str) -> DataFrame | None:
        try:
            found = self.spark.read.parquet(self._path(source, key))
            found.limit(1).collect()
            return found
        except Exception:  # noqa: BLE001 - whatever is wrong with an entry, it is a miss
            return None

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def status(self) -> list[dict]:
        """Entries with source, key, bytes and time, the newest first."""
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        out = []
        for s in fs.listStatus(path(self.folder)):
            for e in fs.listStatus(s.getPath()):
                size = fs.getContentSummary(e.getPath()).getLength()
                out.append({"source": s.getPath().getName(), "key": e.getPath().getName(), "bytes": size, "time": e.getModificationTime()})
        return sorted(out, key=lambda e: (-e["time"], e["source"], e["key"]))

    def clear(self, source: str | None = None) -> int:
        """Remove all entries, or those of a source; returns how many there were."""
        fs, path = self._fs()
        gone = [e for e in self.status() if source is None or e["source"] == source]
        for e in gone:
            fs.delete(path(self._path(e["source"], e["key"])), True)
        return len(gone)
