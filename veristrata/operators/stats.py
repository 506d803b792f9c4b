"""Rank statistics, bins and direct standardization (A12-A14, W3-W9, W13). Sums are of integers where the data are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sum(df: DataFrame, order: str, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """df with the running sum of a count column along a numeric order of distinct values, in range buckets: only a total a bucket
    passes one task."""
    n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] or []  # n - 1 numbers
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    dealt = df.withColumn("_b", place)
    totals = dealt.groupBy("_b").agg(F.sum(value).alias("_t"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_t0"))
    own = F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "_b").withColumn(name, F.col("_t0") + own).drop("_b", "_t0")  # a row a bucket


def midranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1, ties averaged. Only the distinct values with their counts are ordered, not the rows."""
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranked = prefix_sum(per, value, "_n", "_upto").select(value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranked, value)


def rank_sum(df: DataFrame, value: str, group: Column) -> DataFrame:
    """One row: sizes, AUC of group over the rest, and the normal z (no tie correction)."""
    r = midranks(df.select(value, group.alias("_g")).where("_g is not null"), value)
    a = r.agg(F.sum(F.col("_g").cast("long")).alias("n1"), F.sum((~F.col("_g")).cast("long")).alias("n0"), F.sum(F.when(F.col("_g"), F.col("rank"))).alias("s"))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    nn = F.nullif(F.col("n1") * F.col("n0"), F.lit(0))
    return a.select("n1", "n0", (u / nn).alias("auc"), F.coalesce((u - nn / 2) / F.sqrt(nn * (F.col("n1") + F.col("n0") + 1) / 12), F.lit(0.0)).alias("z"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson correlation of midranks."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return midranks(midranks(both, x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def quantile_edges(df: DataFrame, value: str, k: int) -> list[float]:
    """The values at places int(i n / k) of the sorted column, i = 1 .. k - 1 (not ntile, which splits ties).

    Only distinct values with their counts are ordered.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    upto = prefix_sum(per, value, "n", "upto")
    n = per.agg(F.sum("n")).first()[0] or 0
    out = []
    if n:
        tests = [F.min(F.when(F.col("upto") > i * n // k, F.col(value))).alias(f"e{i}") for i in range(1, k)]
        out = list(upto.agg(*tests).first())
    return out


def binned(value: Column, edges: list[float]) -> Column:
    """How many edges are at or below the value."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def order_statistic(values: Column, place: Column) -> Column:
    """The element at a 0-based place of the sorted array."""
    return F.try_element_at(F.sort_array(values), place + 1)


def upper_median(values: Column) -> Column:
    return order_statistic(values, F.floor(F.size(values) / 2).cast("int"))


#: Rows among which a place is looked up at last, and the share of the rows on either side of a place that a round keeps.
FEW, NEAR = 100_000, 0.005


def nth_values(df: DataFrame, value: str, places: list[int]) -> list[float | None]:
    """The values (as doubles) at 0-based places of the sorted column, nulls left out; null beyond its ends. Exact, whatever the
    number of different values, and no task holds more than a few: each round takes two approximate quantiles beside the
    place, counts exactly what lies below, between and above, and goes on with the range that holds it, until that is one value
    or FEW rows. Any order of rows and any ties give the same. NaN sorts last.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    fine = ~F.isnan("v")
    whole = v.agg(F.count("*").alias("n"), F.min(F.when(fine, F.col("v"))).alias("lo"), F.max(F.when(fine, F.col("v"))).alias("hi"), F.count_if(~fine).alias("odd")).first()
    return [_nth(v.where(fine), whole, place) for place in places]


def _nth(v: DataFrame, whole, place: int) -> float | None:
    if not 0 <= place < whole["n"]:
        return None
    lo, hi, before, n = whole["lo"], whole["hi"], 0, whole["n"] - whole["odd"]
    if place >= n:
        return float("nan")
    x = F.col("v")
    while lo < hi and n > FEW:  # n rows lie from lo to hi, `before` below lo
        own = v.where(x.between(lo, hi))
        p = (place - before + 0.5) / n
        a, z = own.agg(F.percentile_approx("v", [max(0.0, p - NEAR), min(1.0, p + NEAR)], 10_000).alias("c")).first()["c"]
        if (a, z) == (lo, hi):  # a few values fill the range: its ends are taken off
            ends = own.agg(F.count_if(x == lo).alias("first"), F.count_if(x == hi).alias("last"), F.min(F.when(x > lo, x)).alias("lo"), F.max(F.when(x < hi, x)).alias("hi")).first()
            if place < before + ends["first"]:
                return lo
            if place >= before + n - ends["last"]:
                return hi
            lo, hi, before, n = ends["lo"], ends["hi"], before + ends["first"], n - ends["first"] - ends["last"]
            continue
        c = own.agg(F.count_if(x < a).alias("below"), F.count_if(x.between(a, z)).alias("mid"), F.max(F.when(x < a, x)).alias("hi"), F.min(F.when(x > z, x)).alias("lo")).first()
        if place < before + c["below"]:
            hi, n = c["hi"], c["below"]
        elif place < before + c["below"] + c["mid"]:
            lo, hi, before, n = a, z, before + c["below"], c["mid"]
        else:
            lo, before, n = c["lo"], before + c["below"] + c["mid"], n - c["below"] - c["mid"]
    if lo == hi:
        return lo
    return v.where(x.between(lo, hi)).orderBy("v").limit(place - before + 1).agg(F.max("v")).first()[0]  # FEW rows


def exact_percentile(df: DataFrame, value: str, p: float) -> float | None:
    """As Spark's percentile (linear between the two places beside p), without its one state of all different values."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return None
    at = p * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    a, z = nth_values(df, value, [low, high]) if high > low else nth_values(df, value, [low]) * 2
    return a if low == high or a == z else (high - at) * a + (at - low) * z


def risk_ratio(df: DataFrame, exposed: Column, outcome: Column) -> DataFrame:
    """One row: crude risks and their ratio."""
    x, y = exposed.cast("long"), outcome.cast("long")
    a = df.agg(F.sum(x * y).alias("k1"), F.sum(x).alias("n1"), F.sum((1 - x) * y).alias("k0"), F.sum(1 - x).alias("n0"))
    p1, p0 = F.col("k1") / F.nullif(F.col("n1"), F.lit(0)), F.col("k0") / F.nullif(F.col("n0"), F.lit(0))
    return a.select("k1", "n1", "k0", "n0", (p1 / F.nullif(p0, F.lit(0.0))).alias("rr"))


def standardized_risk_ratio(df: DataFrame, exposed: Column, outcome: Column, stratum: str) -> DataFrame:
    """A13, first variant: both arms reweighted to the strata of all rows; a stratum that lacks an arm is skipped, without
    renormalizing."""
    x, y = exposed.cast("long"), outcome.cast("long")
    cells = df.groupBy(stratum).agg(F.count("*").alias("n"), F.sum(x * y).alias("k1"), F.sum(x).alias("n1"), F.sum((1 - x) * y).alias("k0"), F.sum(1 - x).alias("n0"))
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    w = lambda k, n: F.sum(F.when(both, F.col("n") * F.col(k) / F.col(n)))
    a = cells.agg(F.sum("n").alias("n"), w("k1", "n1").alias("s1"), w("k0", "n0").alias("s0"))
    return a.select((F.col("s1") / F.col("n")).alias("p1"), (F.col("s0") / F.col("n")).alias("p0"), (F.col("s1") / F.nullif(F.col("s0"), F.lit(0.0))).alias("rr"))


def standardized_mean(df: DataFrame, value: str, stratum: str, by: str, renormalize: bool = True, min_n: int = 1) -> DataFrame:
    """A13, second and third variants: (by, mean): stratum means weighted by the strata of all rows; renormalize over the strata that
    have min_n rows in the group, or not."""
    weights = df.groupBy(stratum).agg(F.count("*").alias("w"))
    cells = df.groupBy(by, stratum).agg(F.count("*").alias("n"), F.sum(value).alias("s")).where(F.col("n") >= min_n).join(weights, stratum)
    total = df.agg(F.count("*").alias("all"))
    top = F.sum(F.col("w") * F.col("s") / F.col("n"))
    return cells.groupBy(by).agg(top.alias("t"), F.sum("w").alias("w")).crossJoin(F.broadcast(total)).select(by, (F.col("t") / (F.col("w") if renormalize else F.col("all"))).alias("mean"))  # one row


def monotone(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: steps along the order, steps up, and whether the value never falls. df is a report: a row a bin."""
    last = F.lag(value).over(Window.orderBy(order))
    steps = df.select(F.col(value).alias("v"), last.alias("p")).where("p is not null")
    return steps.agg(F.count("*").alias("steps"), F.coalesce(F.sum((F.col("v") > F.col("p")).cast("long")), F.lit(0)).alias("up"), F.coalesce(F.bool_and(F.col("v") >= F.col("p")), F.lit(True)).alias("never_falls"))


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The k first rows, or those of each group; each task passes k rows a group at most."""
    if not by:
        return df.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")


def last_minus_first(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: the value of the last bin less that of the first."""
    return df.agg((F.max_by(value, order) - F.min_by(value, order)).alias("difference"))


def cross_tab(df: DataFrame, row: str, column: str, values: list[str], flag: Column) -> DataFrame:
    """(row, <value>_n, <value>_hits ...): rows and flagged rows of each row label and column value, in one pass."""
    sums = []
    for v in values:
        on = F.col(column) == v
        sums += [F.sum(on.cast("long")).alias(f"{v}_n"), F.sum((on & flag).cast("long")).alias(f"{v}_hits")]
    return df.groupBy(row).agg(*sums)
