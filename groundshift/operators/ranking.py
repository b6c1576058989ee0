"""Places within a key and order statistics without bringing a key's rows into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundshift.plans.scratch import checked_side, materialize

#: Values that a nested list may hold.
PAGE = 1000
#: Parts of keys (a key in a range partition) up to which they are broadcast, and classes of a histogram.
PARTS_BROADCAST = 100_000
CLASSES = 1024


def placed(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in their key's order; as ``row_number`` over a window, which sorts a key in one task.

    Rows are dealt by ranges of key and order, so a key may take many partitions; a place is that in the partition plus how
    many of the key's rows the partitions before hold. Without ``keys`` all rows are one key. Ties take any order.
    """
    lead = [F.col(k).asc_nulls_first() for k in keys]
    order = [o if isinstance(o, Column) else F.col(o) for o in order]
    sorted_rows = rows.repartitionByRange(*lead, *order).sortWithinPartitions(*lead, *order).withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = materialize(sorted_rows.withColumn("_part", F.shiftright("_at", 33)), "placed")
    parts = sorted_rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # rows of a key: partitions
    parts = materialize(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "placed-parts")
    side = checked_side(parts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_part": "_p"}), parts.count(), PARTS_BROADCAST)
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return sorted_rows.join(side, on).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int").alias(name))


def paged(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str = "items", size: int = PAGE, lead: int = 0) -> DataFrame:
    """keys, page (from 0), first and ``name``: each key's values in order, in lists of ``size`` (page 0: ``lead`` more); ``first`` is the key's first value.

    Keys are counted before the shuffle. One of no more rows than page 0 takes is one list; the rows of any other get
    their places by ranges of keys (``placed``), so its pages are made apart and no task holds it whole. Null keys are a key.
    """
    rows = rows.select(*keys, F.struct(*order, value.alias("_value")).alias("_o"))
    large = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size + lead).drop("_n"), "large-keys")
    n_large = large.count()

    def meet(some: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
        side = side.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        return some.join(checked_side(side, n_large, PARTS_BROADCAST), on, how)

    small = meet(rows, large, "left_anti") if n_large else rows
    out = small.groupBy(*keys).agg(F.array_sort(F.collect_list("_o")).alias("_all")).select(*keys, F.lit(0).alias("page"), F.col("_all")[0]["_value"].alias("first"), "_all")
    if n_large:
        hot = placed(meet(rows, large).select(*keys, "_o"), keys, [F.col("_o")], "_place")
        heads = materialize(hot.where("_place = 1").select(*keys, F.col("_o._value").alias("first")), "large-heads")
        pages = hot.withColumn("page", F.expr(f"int(greatest(_place - 1 - {lead}, 0) div {size})")).groupBy(*keys, "page").agg(F.array_sort(F.collect_list("_o")).alias("_all"))
        out = out.unionByName(meet(pages, heads).select(*keys, "page", "first", "_all"))
    return out.select(*keys, "page", "first", F.transform("_all", lambda x: x["_value"]).alias(name))


def order_statistics(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and q0, q1, ...: exact percentiles of each key's values, linear between neighbours; nulls, NaN and infinities are left out.

    Selection by histograms: every wanted rank keeps an interval of values; a round counts the values in ``CLASSES``
    classes of it and keeps the class with the rank, until that is a single value. Counts are aggregated before the
    shuffle and no values are gathered; a round narrows an interval a thousandfold, integers of 12 bits take two.
    """
    v = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.abs("_v") < float("inf"))
    ends = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = lambda s: (F.col("_n") - 1) * F.lit(float(s))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil(at(s)) if up else F.floor(at(s))).alias("rank")) for i, s in enumerate(shares) for up in (0, 1)])
    state = materialize(ends.select(*keys, "_n", "_lo", "_hi", F.explode(wanted).alias("w")).select(*keys, "_n", "_lo", "_hi", F.col("w.i").alias("_i"), F.col("w.up").alias("_up"), F.col("w.rank").cast("long").alias("_rank")), "ranks")
    done = state.where("_lo = _hi")
    state = state.where("_lo < _hi")
    while not state.isEmpty():
        asked = state.select(*keys, "_lo", "_hi").distinct()  # a few intervals a key
        met = v.join(checked_side(asked, asked.count(), PARTS_BROADCAST), keys).where("_v between _lo and _hi")
        place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CLASSES), F.lit(CLASSES - 1))
        counted = met.groupBy(*keys, "_lo", "_hi", place.alias("_c")).agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_lo2"), F.max("_v").alias("_hi2"))
        so_far = F.sum("_k").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_c"))  # CLASSES rows at most
        found = materialize(counted.withColumn("_to", so_far).withColumn("_from", F.col("_to") - F.col("_k")), "ranks-classes")
        state = state.join(found.hint("merge"), [*keys, "_lo", "_hi"]).where("_rank >= _from and _rank < _to")
        state = materialize(state.select(*keys, "_n", F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), "_i", "_up", (F.col("_rank") - F.col("_from")).alias("_rank")), "ranks")
        done, state = done.unionByName(state.where("_lo = _hi")), state.where("_lo < _hi")
    pick = lambda i, up: F.max(F.when((F.col("_i") == i) & (F.col("_up") == up), F.col("_lo")))
    between = lambda i, s: pick(i, 0) + (pick(i, 1) - pick(i, 0)) * (F.max(at(s)) - F.floor(F.max(at(s))))
    return done.groupBy(*keys).agg(*[between(i, s).alias(f"q{i}") for i, s in enumerate(shares)])
