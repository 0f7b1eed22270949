"""Maintained period balances: what each account moved in each month, kept on Parquet.

A report that opens with "everything before the date" otherwise sums all history on every run.
Here the sums per (account, month) and per (account, year) are stored, so an opening reads the
years before, the months of its own year, and only the lines of the month that the date cuts.

Layout under ``path``: ``data/load=.../grain=.../period=...`` holds the rows of one load, and
``manifest/version=<n>`` names, for every stored period, the load that holds it with a checksum of
the lines behind it. A load writes its data first and its manifest last; Spark commits each as a
whole and marks it with ``_SUCCESS``. Readers take the highest marked manifest, so they see the old balances or the new ones,
never a mixture, and a load that dies half way leaves files that no manifest names. Old loads
stay for readers that run meanwhile; whoever owns the folder removes them. One writer at a time.

``refresh`` compares the checksums of the lines with the manifest and sums anew only the months
that differ (new lines, late corrections, deletions) and the years that hold them. The manifest
has one row a period, so it is bounded by the calendar and is read to the driver.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

from ledgerflow.functions.predicates import in_periods
from ledgerflow.sources.published import versions

_MANIFEST = "period int, grain string, load string, n_lines long, check string"
MONTH, YEAR = "month", "year"


class PeriodBalances:
    """Balances of ``keys`` per month and year of ``date``, sums of ``measures``.

    ``measures``: ``(name, value)`` pairs over the lines; values must be exact (decimals, integers), so that
    a stored sum equals a fresh one. Lines without a date are in no period: they are refused.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], date: str,
                 measures: Sequence[tuple[str, Column]]):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.date, self.measures = list(keys), date, list(measures)

    def _prepared(self, lines: DataFrame) -> DataFrame:
        return lines.select(*self.keys, self.date, *[v.alias(n) for n, v in self.measures],
                            (F.year(self.date) * 100 + F.month(self.date)).alias("period"))

    def _versions(self) -> tuple[int, int]:
        return versions(self.spark, self.path)

    def manifest(self) -> dict[tuple[str, int], tuple]:
        """``(grain, period) -> (load, n_lines, check)`` of the newest complete load."""
        v, _ = self._versions()
        if not v:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={v}").collect()
        return {(r.grain, r.period): (r.load, r.n_lines, r.check) for r in rows}

    def _checksums(self, p: DataFrame) -> dict[int, tuple[int, str]]:
        """Lines and a sum of line hashes per month, the same in any order of lines; one row a month."""
        h = F.xxhash64(*self.keys, self.date, *[n for n, _ in self.measures]).cast("decimal(38,0)")
        rows = p.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("check")).collect()
        if any(r.period is None for r in rows):
            raise ValueError(f"lines without {self.date}: they belong to no period")
        return {r.period: (r.n, r["check"]) for r in rows}

    def _stored_type(self, p: DataFrame, name: str):
        """Every stored sum of a measure has one type, whatever it was added up from."""
        t = p.schema[name].dataType
        return DecimalType(38, t.scale) if isinstance(t, DecimalType) else LongType()

    def _sums(self, p: DataFrame) -> list[Column]:
        return [F.sum(n).cast(self._stored_type(p, n)).alias(n) for n, _ in self.measures]

    def refresh(self, lines: DataFrame, periods: Sequence[int] | None = None) -> list[int]:
        """Bring the store up to ``lines`` (the whole table); the months that were summed anew or
        dropped, in order. ``periods`` (``YYYYMM``) are the only months looked at, where the caller
        knows which can have changed; else all are. Nothing changed: nothing is written."""
        p, old = self._prepared(lines), self.manifest()
        now = self._checksums(p if periods is None else p.where(in_periods(self.date, periods)) if periods else p.limit(0))
        before = {m: v[1:] for (grain, m), v in old.items() if grain == MONTH and (periods is None or m in periods)}
        changed = sorted(m for m in now.keys() | before.keys() if now.get(m) != before.get(m))
        if not changed:
            return []
        load = uuid.uuid4().hex
        fresh, years = [m for m in changed if m in now], sorted({m // 100 for m in changed})
        if fresh:
            # The list of months reaches the scan as a date range beside the exact list.
            m = p.where(in_periods(self.date, fresh)).groupBy(*self.keys, "period").agg(*self._sums(p))
            self._write(m, load, MONTH)
        entry = {(g, x): v for (g, x), v in old.items() if not (x in changed if g == MONTH else x in years)}
        entry |= {(MONTH, x): (load, *now[x]) for x in fresh}
        months = {k: v for k, v in entry.items() if k[0] == MONTH and k[1] // 100 in years}
        if months:
            y = self._read(months, p)
            y = y.groupBy(*self.keys, F.expr("period div 100").cast("int").alias("period")).agg(*self._sums(y))
            self._write(y, load, YEAR)
            for x in sorted({k[1] // 100 for k in months}):
                entry[YEAR, x] = (load, sum(v[1] for k, v in months.items() if k[1] // 100 == x), "")
        self._publish(entry)
        return changed

    def _write(self, rows: DataFrame, load: str, grain: str) -> None:
        (rows.repartitionByRange("period", *self.keys)              # a period's rows lie in few files
             .write.partitionBy("period").parquet(f"{self.path}/data/load={load}/grain={grain}"))

    def _publish(self, entry: dict) -> None:
        rows = [(period, grain, *v) for (grain, period), v in sorted(entry.items())]
        (self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)     # one row a period
             .write.parquet(f"{self.path}/manifest/version={self._versions()[1] + 1}"))

    def _read(self, entry: dict, p: DataFrame) -> DataFrame | None:
        """The rows of the named periods, whichever load holds them (``p``: lines of the same
        types); None without periods."""
        paths = [f"{self.path}/data/load={load}/grain={grain}/period={x}" for (grain, x), (load, *_) in sorted(entry.items())]
        if not paths:
            return None
        cols = [StructField(k, p.schema[k].dataType) for k in self.keys]
        cols += [StructField(n, self._stored_type(p, n)) for n, _ in self.measures]
        parts = [StructField("load", StringType()), StructField("grain", StringType()), StructField("period", IntegerType())]
        stored = self.spark.read.option("basePath", f"{self.path}/data").schema(StructType([*cols, *parts])).parquet(*paths)
        return stored.select(*self.keys, *[n for n, _ in self.measures], "period")

    def before(self, lines: DataFrame, start: dt.date) -> DataFrame:
        """Sums of ``measures`` per key over everything before ``start``: the stored years, the
        stored months of its year, and the lines from the first of its month up to the day before.
        Equal to the sum over all lines, as of the last ``refresh``. Keys without lines before
        ``start`` do not appear."""
        month, this = dt.date(start.year, start.month, 1), start.year * 100 + start.month
        p = self._prepared(lines)
        entry = {(g, x): v for (g, x), v in self.manifest().items()
                 if (x < start.year if g == YEAR else start.year * 100 < x < this)}
        cut = p.where((F.col(self.date) >= F.lit(month)) & (F.col(self.date) < F.lit(start)))
        cut = cut.select(*self.keys, *[F.col(n).cast(self._stored_type(p, n)).alias(n) for n, _ in self.measures], "period")
        rows = [x for x in (self._read(entry, p), cut) if x is not None]
        return reduce(DataFrame.unionByName, rows).groupBy(*self.keys).agg(*self._sums(cut))
