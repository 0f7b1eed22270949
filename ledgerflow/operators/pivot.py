"""Wide pivots and crosstabs.

``wide_pivot`` turns (key, category, value) rows into one row per key with one column
per *declared* category. Each column is a conditional aggregate, so the whole pivot is a
single hash aggregation with map-side partial aggregation (a hot key is reduced to one
row per map task before the shuffle) and no job to discover category values. Column
names come from the declared ``(value, alias)`` list, never from the data, so a category
list in another order cannot relabel columns.

``query_pivot`` takes its categories from a relation instead, as a crosstab with a category
query does: one small job ranks them, and its size is checked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions._cols import as_col

Category = tuple  # (value or tuple of values merged into one column, alias)


def _hit(category: Column, value) -> Column:
    if isinstance(value, (list, tuple, set, frozenset)):
        return category.isin(list(value))
    return category == F.lit(value)


def cell(category, value, measure, agg: str = "sum", order: Sequence | None = None) -> Column:
    """Aggregate of ``measure`` over the rows whose category equals ``value``."""
    cat = as_col(category)
    m = as_col(measure)
    hit = _hit(cat, value)
    if agg == "sum":
        return F.sum(F.when(hit, m))
    if agg == "count":
        return F.count(F.when(hit, F.lit(1)))
    if agg == "max":
        return F.max(F.when(hit, m))
    if agg == "min":
        return F.min(F.when(hit, m))
    if agg == "last":
        if not order:
            raise ValueError("agg='last' needs an explicit order (a full tie-break)")
        return F.max_by(F.when(hit, m), F.when(hit, F.struct(*[as_col(o) for o in order])))
    raise ValueError(f"unknown agg {agg!r}")


def wide_pivot(df: DataFrame, keys: Sequence, category, categories: Sequence[Category], measure,
               agg: str = "sum", order: Sequence | None = None, fill=0,
               extra: Sequence[Column] = ()) -> DataFrame:
    """One row per ``keys``; one column per declared ``(category value, alias)``.

    ``agg``: ``sum`` (default), ``count``, ``max``, ``min``, or ``last`` (value of the
    last row by ``order`` — the cell a row-by-row crosstab keeps). Missing cells become
    ``fill`` (None keeps NULL). ``extra`` are further aggregate columns on the same pass.
    """
    cols = []
    for value, alias in categories:
        c = cell(category, value, measure, agg, order)
        if fill is not None:
            c = F.coalesce(c, F.lit(fill))
        cols.append(c.alias(alias))
    return df.groupBy(*keys).agg(*cols, *extra)


MAX_CATEGORIES = 500
DIRECT_CATEGORIES = 16      # cells of a key that are kept for each row group


def category_ranks(categories: DataFrame, category: str, order: Sequence | None = None,
                   max_categories: int = MAX_CATEGORIES) -> list:
    """The distinct non-NULL values of ``category`` in report order (``order``, by default the
    value; a value that stands in several rows takes its first place). More than
    ``max_categories`` raise an error: they would be as many columns."""
    rank = F.min(F.struct(*[as_col(o) for o in (order or [category])], as_col(category)))
    ranked = (categories.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("_value"))
                        .agg(rank.alias("_rank")).orderBy("_rank").limit(max_categories + 1))
    found = [r["_value"] for r in ranked.select("_value").collect()]
    if len(found) > max_categories:
        raise ValueError(f"over {max_categories} categories for a crosstab")
    return found


def query_pivot(df: DataFrame, keys: Sequence[str], category: str, measure: Column, categories: DataFrame,
                order: Sequence | None = None, name: Callable[[object], str] = str, fill=0,
                max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Crosstab whose columns come from the relation ``categories`` (with a column ``category``),
    ranked by ``order``: a category that is added to the relation becomes a column without a
    change of code. One row per ``keys``, one column per category, named ``name(value)``, with the
    sum of ``measure`` (``fill`` where there is none).

    Rows of a category outside the relation, or of none (NULL), add nothing, but their keys stay.
    Up to ``DIRECT_CATEGORIES`` cells are summed by keys at once, one group for the rows of a key.
    More are summed by (keys, rank) before they become columns, so the work per row does not grow
    with the number of categories. Names that clash, also in letter case, raise an error.
    """
    found = category_ranks(categories, category, order, max_categories)
    labels = [name(v) for v in found]
    seen = Counter(x.lower() for x in [*keys, *labels])
    if twice := sorted(x for x, n in seen.items() if n > 1):
        raise ValueError(f"crosstab columns named twice: {twice}")
    if not found:
        return df.select(*keys).distinct()
    spark = df.sparkSession
    typ = df.schema[category].dataType.simpleString()
    ranks = F.broadcast(spark.createDataFrame(list(enumerate(found)), f"_rank int, _value {typ}"))   # <= max_categories rows
    ranked = df.select(*keys, F.col(category).alias("_value"), measure.alias("_m")).join(ranks, "_value", "left")
    filled = (lambda c: c) if fill is None else (lambda c: F.coalesce(c, F.lit(fill)))
    if len(found) <= DIRECT_CATEGORIES:
        return ranked.groupBy(*keys).agg(*[filled(cell("_rank", i, "_m")).alias(x) for i, x in enumerate(labels)])
    cells = ranked.groupBy(*keys, "_rank").agg(F.sum("_m").alias("_m"))
    own = F.collect_list(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "_m")))       # one entry a category at most
    wide = cells.groupBy(*keys).agg(F.map_from_entries(own).alias("_cells"))
    return wide.select(*keys, *[filled(F.col("_cells")[i]).alias(x) for i, x in enumerate(labels)])


def rollup_sets(*groups: Sequence[str]) -> list[list[str]]:
    """Grouping sets of ``ROLLUP(g1) x ROLLUP(g2) x ...`` (each group rolled up in order)."""
    sets: list[list[str]] = [[]]
    for g in groups:
        levels = [list(g[:i]) for i in range(len(g), -1, -1)]
        sets = [s + lv for s in sets for lv in levels]
    return sets


def crosstab_totals(df: DataFrame, rows: Sequence[str], cols: Sequence[str],
                    measures: Sequence[Column], level_col: str = "gid") -> DataFrame:
    """Crosstab cells with row subtotals, column subtotals and the grand total.

    Equal to ``GROUP BY ROLLUP(rows), ROLLUP(cols)``: one Expand + one aggregation;
    ``level_col`` is ``grouping_id(rows..., cols...)`` (bit set = rolled up).
    """
    keys = [*rows, *cols]
    return (df.groupingSets(rollup_sets(rows, cols), *keys)
              .agg(*measures, F.grouping_id(*keys).alias(level_col)))
