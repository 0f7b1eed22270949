"""Reports that are published again: partitions replaced as a whole, readers never see half a report.

Layout under ``path``: ``data/load=<id>/_part=p<value>`` holds what one publication wrote, and
``manifest/version=<n>`` names for every partition the load that holds it. A publication writes its
data first and its manifest last, and Spark marks each finished write with ``_SUCCESS``; readers take
the highest marked manifest, so they see the report before or after a publication. One that dies half
way leaves files that no manifest names, and running it again gives the same report. Old loads
stay for readers that run meanwhile; whoever owns the folder removes them. One writer at a time: a
second one that takes the same version number gets an error.

The manifest has one row a partition; partitions are report periods, so it is read to the driver,
behind a check of its size.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MAX_PARTITIONS = 100_000
_MANIFEST = "part string, load string, n_rows long, columns string"


def versions(spark: SparkSession, path: str) -> tuple[int, int]:
    """The newest complete manifest under ``path`` and the highest number in use (0: none)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{path}/manifest")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0, 0
    found = {int(x.getPath().getName().split("=")[1]): fs.exists(hadoop.Path(x.getPath(), "_SUCCESS"))
             for x in fs.listStatus(root) if x.getPath().getName().startswith("version=")}
    return max((n for n, done in found.items() if done), default=0), max(found, default=0)


def _one_of(c: Column, parts: Collection[str | None]) -> Column:
    """Whether a folder's text, which may be NULL, is that of one of the partitions, or None's."""
    named = ["p" + p for p in parts if p is not None]
    hit = F.coalesce(c.isin(named), F.lit(False)) if named else F.lit(False)
    return hit | c.isNull() if None in parts else hit


class PublishedReport:
    """A report under ``path``, partitioned by ``column`` (a period, say)."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column

    def _rows(self) -> list:
        version, _ = versions(self.spark, self.path)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect() if version else []

    def partitions(self) -> dict[str | None, tuple[str, int]]:
        """``partition -> (load, rows)`` of the newest complete publication."""
        return {r.part: (r.load, r.n_rows) for r in self._rows() if r.load}

    def _schema(self) -> StructType | None:
        return next((StructType.fromJson(json.loads(r["columns"])) for r in self._rows()), None)

    def publish(self, report: DataFrame, replace: Collection | None = None) -> list[str | None]:
        """Publish ``report`` and return the partitions that were replaced, in order.

        Its rows replace the partitions that they belong to, and others stay. ``replace`` names
        the partitions that the report was made for (None: the NULL partition): those without rows
        become empty, and rows of a partition that it doesn't name are refused. A report with
        other columns than the published one is refused. Nothing to replace: nothing is written."""
        named = None if replace is None else {None if p is None else str(p) for p in replace}
        old, known = self.partitions(), self._schema()
        types = StructType([StructField(f.name, f.dataType) for f in report.schema])
        if taken := {"load", "_part"}.intersection(map(str.lower, types.names)):
            raise ValueError(f"column names of the store's own: {sorted(taken)}")
        if known is not None and [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in types]:
            raise ValueError(f"other columns than those published: {types.simpleString()}")
        load = uuid.uuid4().hex
        # the partition as text beside the column itself, which keeps its type and exact values in the
        # files; behind a letter, since the empty text has no folder of its own
        (report.withColumn("_part", F.concat(F.lit("p"), F.col(self.column).cast("string")))
               .hint("rebalance", "_part")          # a partition in one file, a large one in several
               .write.partitionBy("_part").parquet(f"{self.path}/data/load={load}"))
        counts = (self._read(types, [load]).groupBy("_part").count().limit(MAX_PARTITIONS + 1).collect())
        if len(counts) > MAX_PARTITIONS:
            raise ValueError(f"over {MAX_PARTITIONS} partitions in a report")
        fresh = {r["_part"] and r["_part"][1:]: (load, r["count"]) for r in counts}
        if named is not None and (more := fresh.keys() - named):
            raise ValueError(f"rows of partitions that were not to be replaced: {sorted(map(str, more))[:10]}")
        gone = (named or set()) & old.keys() - fresh.keys()
        if not fresh and not gone:
            return []
        entry = {p: v for p, v in old.items() if p not in gone} | fresh
        # a report without partitions keeps its columns in a row without a load
        rows = [(p, *v, types.json()) for p, v in entry.items()] or [(None, None, 0, types.json())]
        (self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)           # one row a partition
             .write.parquet(f"{self.path}/manifest/version={versions(self.spark, self.path)[1] + 1}"))
        return sorted(fresh.keys() | gone, key=lambda p: (p is not None, p))

    def _read(self, types: StructType, loads: Collection[str]) -> DataFrame:
        schema = StructType([*types, StructField("load", StringType()), StructField("_part", StringType())])
        paths = [f"{self.path}/data/load={x}" for x in sorted(loads)]
        return self.spark.read.option("basePath", f"{self.path}/data").schema(schema).parquet(*paths)

    def read(self, parts: Collection | None = None) -> DataFrame:
        """The report as last published, or its partitions ``parts``; only their folders are read."""
        types = self._schema()
        if types is None:
            raise ValueError(f"nothing is published under {self.path}")
        named = None if parts is None else {None if p is None else str(p) for p in parts}
        by_load = defaultdict(list)
        for part, (load, _) in self.partitions().items():
            if named is None or part in named:
                by_load[load].append(part)
        if not by_load:
            return self.spark.createDataFrame([], types)
        held = F.lit(False)
        for load, own in sorted(by_load.items()):
            held |= (F.col("load") == load) & _one_of(F.col("_part"), own)
        return self._read(types, by_load).where(held).select(*types.names)
