"""Report output: the reports themselves only render pages; here a result is written as
partitioned parquet (the sink a downstream consumer reads)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                 max_records_per_file: int | None = None) -> None:
    """Write ``df`` to ``path`` as parquet, partitioned by ``partition_by`` (e.g. period),
    so a later read of one period prunes the other directories."""
    w = df.write.mode(mode).format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(max_records_per_file))
    w.save(path)
