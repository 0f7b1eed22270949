import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerflow.sources import write_report


def test_report_round_trip_partitioned(spark):
    df = E.queries()["monthly_journal"](spark, "/root/testdata/sf0.001")
    out = tempfile.mkdtemp(prefix="ledgerflow-sink-") + "/monthly_journal"
    write_report(df, out, partition_by=["yr"])
    back = spark.read.parquet(out)
    assert back.count() == df.count()
    one = back.where(F.col("yr") == 1996)
    assert "PartitionFilters: [isnotnull(yr" in one._jdf.queryExecution().executedPlan().toString()
