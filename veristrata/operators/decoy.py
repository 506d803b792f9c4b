"""Target-decoy operators: q sweep (W1, W2), ledger (A5-A8), rates and fit (A22, W12, R12, R13), contract (K4)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veristrata import config as C
from veristrata.functions.columns import multiplicity


def check_options(alpha: float, unit: str, columns: list[str], needed: list[str], score: str | None, q: str | None) -> None:
    """What would otherwise fail silently is an error before any plan is made."""
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must lie in (0, 1]: {alpha}")
    if unit not in ("psm", "peptide", "unique-peptide"):
        raise ValueError(f"unknown unit: {unit}")
    if missing := [c for c in needed if c not in columns]:
        raise ValueError(f"columns not in the input: {', '.join(missing)}")
    if (score is None) == (q is None):
        raise ValueError("name a score to sweep or a q-value column, one of them")


def q_sweep(psms: DataFrame, score: str, decoy: str, order: str, ascending: bool = False, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Psms with q: best score first (ties in row order), cumulative decoys over targets, then the least of those from there on.

    Rows without a score keep no q. The order is global, but no task sees all rows: rows are dealt to ranges of the score, and
    rows of one very common score to ranges of `order`; the totals of the ranges give each its starting counts, and their
    minima the bound that comes from behind. Only those totals pass a single task. by: one sweep for each group, whose rows
    are dealt to the same ranges.
    """
    by = by or []
    live = psms.where(F.col(score).isNotNull()).withColumn("_s", F.col(score).cast("double") * (1 if ascending else -1))
    n = buckets or max(2, int(psms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = live.agg(F.percentile_approx("_s", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] or []  # n - 1 numbers
    once, common = sorted(set(cuts)), sorted({c for c in cuts if cuts.count(c) > 1})
    place = lambda own, c: F.size(F.filter(own, lambda x: x < c))
    own = place(F.array(*[F.lit(float(c)) for c in once]), F.col("_s")) if once else F.lit(0)
    live = live.withColumn("_r", 2 * own + F.col("_s").isin(common).cast("int") if common else 2 * own).withColumn("_o", F.lit(0))
    if common and isinstance(psms.schema[order].dataType, T.NumericType):
        parts = live.where(F.col("_s").isin(common)).groupBy("_s").agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)], 10_000).alias("c")).collect()  # a row a common score
        ranges = F.create_map(*[x for r in parts for x in (F.lit(r["_s"]), F.array(*[F.lit(float(c)) for c in sorted(set(r["c"]))]))])
        live = live.withColumn("_o", F.coalesce(F.when(F.col("_s").isin(common), place(ranges[F.col("_s")], F.col(order))), F.lit(0)))
    live = live.withColumn("_b", F.struct("_r", "_o")).drop("_r", "_o")
    key = [*by, "_b"]
    d = F.col(decoy).cast("long")
    totals = live.groupBy(*key).agg(F.sum(d).alias("_d"), F.sum(1 - d).alias("_t"))
    ahead = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*key, F.coalesce(F.sum("_d").over(ahead), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_t0"))
    up = Window.partitionBy(*key).orderBy("_s", order).rowsBetween(Window.unboundedPreceding, 0)
    rate = (F.col("_d0") + F.sum(d).over(up)) / F.greatest(F.col("_t0") + F.sum(1 - d).over(up), F.lit(1))
    rated = live.join(before, key).withColumn("_r", rate)
    behind = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    least = rated.groupBy(*key).agg(F.min("_r").alias("_m")).select(*key, F.coalesce(F.min("_m").over(behind), F.lit(1.0)).alias("_m"))
    down = Window.partitionBy(*key).orderBy(F.desc("_s"), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    done = rated.join(least, key).withColumn("q", F.least(F.lit(1.0), F.col("_m"), F.min("_r").over(down)))
    return done.select(*psms.columns, "q").unionByName(psms.where(F.col(score).isNull()).withColumn("q", F.lit(None).cast("double")))


def accepted(psms: DataFrame, alpha: float, q: str = "q") -> DataFrame:
    """W2."""
    return psms.where(F.col(q) <= alpha)


def unit_rows(psms: DataFrame, unit: str, group: str = "class", peptide: str = "peptide", decoy: str = "is_decoy") -> DataFrame:
    """The rows that are counted."""
    return psms if unit == "psm" else psms.select(group, peptide, decoy).distinct()


def best_q(psms: DataFrame, peptide: str = "peptide", q: str = "q", decoy: str = "is_decoy") -> DataFrame:
    """(peptide, q, targets, decoys): the lowest q of each peptide that has one, and its matches by label."""
    per = psms.groupBy(peptide).agg(F.min(q).alias("q"), F.sum((~F.col(decoy)).cast("long")).alias("targets"), F.sum(F.col(decoy).cast("long")).alias("decoys"))
    return per.where("q is not null")


def fdr(d: Column, t: Column, convention: str = "plus-one") -> Column:
    """(D+1)/T or D/T."""
    return ((d + 1) if convention == "plus-one" else d) / F.greatest(t, F.lit(1))


def ledger(rows: DataFrame, group: str = "class", decoy: str = "is_decoy", convention: str = "plus-one") -> DataFrame:
    """A5: accepted targets and decoys of each class, its FDR and its share of all targets; totals in every row."""
    d = F.col(decoy).cast("long")
    per = rows.groupBy(group).agg(F.sum(1 - d).alias("n_target"), F.sum(d).alias("n_decoy"))
    total = per.agg(F.sum("n_target").alias("all_target"), F.sum("n_decoy").alias("all_decoy"))
    return per.crossJoin(F.broadcast(total)).select(  # one row
        group, "n_target", "n_decoy", fdr(F.col("n_decoy"), F.col("n_target"), convention).alias("class_fdr"), (F.col("n_target") / F.greatest("all_target", F.lit(1))).alias("share"), "all_target", "all_decoy"
    )


def depth_strata(rows: DataFrame, group: str = "class", peptide: str = "peptide", decoy: str = "is_decoy") -> DataFrame:
    """Peptides by how many accepted matches they have."""
    per = rows.groupBy(group, peptide, decoy).agg(F.count("*").alias("k"))
    d = F.col(decoy).cast("long")
    return per.groupBy(group, multiplicity(F.col("k")).alias("depth")).agg(F.sum(1 - d).alias("n_target"), F.sum(d).alias("n_decoy"))


def sample_rates(rows: DataFrame, sample: str, canonical: Column, decoy: str = "is_decoy") -> DataFrame:
    """Share of noncanonical targets, total rate and class rates of each sample; NaN where there is no target."""
    d, c = F.col(decoy).cast("long"), canonical.cast("long")
    nan = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(float("nan")))
    per = rows.groupBy(sample).agg(F.sum(c * (1 - d)).alias("ct"), F.sum(c * d).alias("cd"), F.sum((1 - c) * (1 - d)).alias("nt"), F.sum((1 - c) * d).alias("nd"))
    t = F.col("ct") + F.col("nt")
    return per.select(sample, nan(F.col("nt"), t).alias("f"), nan(F.col("cd") + F.col("nd"), t).alias("q"), nan(F.col("cd"), F.col("ct")).alias("theta_c"), nan(F.col("nd"), F.col("nt")).alias("theta_n"))


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: intercept, slope and residual variance of y on x, n; the standard error at x = 1 can be had from them."""
    ok = df.where(~F.isnan(x) & ~F.isnan(y) & F.col(x).isNotNull() & F.col(y).isNotNull())
    a = ok.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mean_x"))
    s2 = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1))
    se = F.sqrt(s2 * (1 / F.nullif(F.col("n"), F.lit(0)) + F.pow(1 - F.col("mean_x"), 2) / F.nullif(F.col("sxx"), F.lit(0.0))))
    return a.select("n", "slope", "intercept", (F.col("intercept") + F.col("slope")).alias("at_one"), se.alias("se_at_one"))


def constancy(df: DataFrame, value: str) -> DataFrame:
    """Fold and population CV of a rate over samples; any NaN makes the fold infinite (a rate that is undefined isn't constant)."""
    v = F.when(~F.isnan(value), F.col(value))
    a = df.agg(F.count("*").alias("n"), F.sum(F.isnan(value).cast("long")).alias("n_nan"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_pop(v).alias("sd"), F.avg(v).alias("mean"))
    bad = (F.col("n_nan") > 0) | (F.col("lo") <= 0)
    return a.select("n", "n_nan", F.when(bad, F.lit(math.inf)).otherwise(F.col("hi") / F.col("lo")).alias("fold"), F.when(F.col("n_nan") > 0, F.lit(math.nan)).otherwise(F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv"))


def verdict(n: int, fold_c: float, fold_n: float, se: float, gap: float) -> str:
    """R13."""
    if n <= 2:
        return "inconclusive"
    violated, wide = max(fold_c, fold_n) >= C.CONSTANCY_FOLD, se > 0.05
    if violated and not wide and gap > 0.01:
        return "deceptive"
    return "violated" if violated else "wide" if wide else "plausible"


def contract(psms: DataFrame, decoy_prefix: str = "rev_") -> DataFrame:
    """K4: the six-column contract of all rows that have a q, accepted or not."""
    return psms.where("q is not null").select("id", "peptide", "score", "q", F.col("is_decoy").cast("int").alias("is_decoy"), F.concat(F.when(F.col("is_decoy"), decoy_prefix).otherwise(""), F.col("accession")).alias("accession"))
