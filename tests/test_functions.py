import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.dates import long_date_es, prev_month_end
from ledgerflow.functions.predicates import in_list, one_of
from ledgerflow.functions.text import split_docnum
from ledgerflow.functions.words import amount_in_words, spell_group
from ledgerflow.operators.aging import bucket_columns
from ledgerflow.operators.totals import share_text

WORDS = [
    (0, 1, "cero quetzales exactos"),
    (0.01, 1, "cero quetzales con 1/100"),
    (1, 1, "un quetzales exactos"),
    (21, 1, "veintiuno quetzales exactos"),
    (30, 2, "treinta dolares exactos"),
    (31, 1, "treinta y uno quetzales exactos"),
    (100, 1, "cien quetzales exactos"),
    (101, 1, "ciento un quetzales exactos"),
    (1000, 1, "mil quetzales exactos"),
    (1001, 1, "mil un quetzales exactos"),
    (21000, 1, "veintiun mil quetzales exactos"),
    (31031.31, 1, "treinta y un mil treinta y uno quetzales con 31/100"),
    (1000000, 1, "un millón quetzales exactos"),
    (2000000.50, 2, "dos millones dolares con 50/100"),
    (-5.25, 1, "-cinco quetzales con 25/100"),
    (999999999.99, 1, "novecientos noventa y nueve millones novecientos noventa y nueve mil "
                      "novecientos noventa y nueve quetzales con 99/100"),
    (1000000000, 1, "---"),
    (None, 1, None),
    (5, 3, None),
]


@pytest.mark.parametrize("amount,cur,expected", WORDS)
def test_amount_in_words(spark, amount, cur, expected):
    df = spark.createDataFrame([(None if amount is None else float(amount), cur)], "a double, c int")
    assert df.select(amount_in_words(F.col("a").cast("decimal(18,2)"), F.col("c")).alias("w")).first().w == expected


def test_group_spelling_rules():
    assert spell_group(1, 2) == " mil"      # 1,000 is "mil", not "un mil"
    assert spell_group(21, 1) == " veintiun millones"
    assert spell_group(100, 3) == " cien" and spell_group(115, 3) == " ciento quince"


def test_split_docnum(spark):
    df = spark.createDataFrame([("A-12",), ("X/2019/0007",), ("NOSEP",), (None,), ("B-12x",), ("X/19",)], "s string")
    series, seq = split_docnum("s")
    got = [(r.series, r.seq) for r in df.select(series.alias("series"), seq.alias("seq")).collect()]
    assert got == [("A", 12), ("X/2019", 7), (None, None), (None, None), ("B", None), (None, None)]


def test_age_bucket_boundaries(spark):
    ages = [0, 2, 3, 5, 6, 8, 9, 10, 11]
    df = spark.createDataFrame([(a,) for a in ages], "age int").withColumn("amt", F.lit(1).cast("decimal(18,2)"))
    rows = df.select("age", *bucket_columns(F.col("age"), F.col("amt"))).orderBy("age").collect()
    which = [[k for k in ("d0_2", "d3_5", "d6_8", "d9_10", "d11_plus") if r[k] == 1][0] for r in rows]
    assert which == ["d0_2", "d0_2", "d3_5", "d3_5", "d6_8", "d6_8", "d9_10", "d9_10", "d11_plus"]


def test_dates_and_shares(spark):
    df = spark.createDataFrame([(dt.date(2021, 3, 5), 35.0, 100.0), (dt.date(2020, 1, 31), 1.0, 0.0)],
                               "d date, part double, total double")
    rows = df.select(long_date_es("d").alias("l"), prev_month_end("d").alias("p"),
                     share_text(F.col("part"), F.col("total")).alias("s")).collect()
    assert rows[0].l == "05 de marzo del 2021" and rows[0].p == dt.date(2021, 2, 28) and rows[0].s == "35%"
    assert rows[1].p == dt.date(2019, 12, 31) and rows[1].s is None


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    assert df.where(in_list("id", None)).count() == 3 and df.where(in_list("id", [])).count() == 3
    assert df.where(in_list("id", [1, 3])).count() == 2
    assert df.where(one_of("id", 0, "name", "b")).first().id == 2
    assert df.where(one_of("id", 3, "name", "b")).first().id == 3
