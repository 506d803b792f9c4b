"""Seeded resampling (R1-R9, R11). Rounds are dealt to groups; what a group needs of the data are counts, in blocks where they are many."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata import config as C
from veristrata.plans.checkpoint import store

# Multiplier and increment of the 64-bit generator.
LCG_MULTIPLIER, LCG_INCREMENT = 6364136223846793005, 1442695040888963407
_MASK = (1 << 64) - 1


def lcg_jump(state: int, steps: int) -> int:
    """The state after so many steps, by repeated squaring of the affine step."""
    a, c, ra, rc = LCG_MULTIPLIER, LCG_INCREMENT, 1, 0
    while steps:
        if steps & 1:
            ra, rc = ra * a & _MASK, (rc * a + c) & _MASK
        a, c = a * a & _MASK, (a * c + c) & _MASK
        steps >>= 1
    return (ra * state + rc) & _MASK


def lcg_draws(seed: int, first: int, n: int, below: int) -> np.ndarray:
    """Draws `first` to `first + n - 1` of (state >> 33) % below, whatever came before."""
    powers, sums = np.empty(n, np.uint64), np.empty(n, np.uint64)
    a, c, x = 1, 0, lcg_jump(seed, first)
    size = 1
    if n:
        powers[0], sums[0] = LCG_MULTIPLIER, LCG_INCREMENT
    while size < n:  # the steps of the first half, then the same again from there on
        m = min(size, n - size)
        a, c = powers[size - 1], sums[size - 1]
        powers[size : size + m] = powers[:m] * a
        sums[size : size + m] = powers[:m] * c + sums[:m]
        size += m
    return ((powers * np.uint64(x) + sums) >> np.uint64(33)).astype(np.int64) % below


#: Clusters whose cells one task holds, and groups that the rounds of a null or bootstrap are dealt to.
CLUSTERS, GROUPS = 50_000, 32


def numbered_keys(df: DataFrame, key: str, number: str) -> DataFrame:
    """Stored: (key, number): the distinct keys in order, from 0. Ranges are numbered on their own; only their sizes pass one task."""
    dealt = df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    own = store(dealt.select(key, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")), "keys")
    sizes = own.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n0"))
    return own.join(ahead, "_p").select(key, (F.col("_n0") + F.col("_i")).alias(number))


#: Draws that a task makes at a time.
DRAWS = 1 << 20


def _draw_counts(spark: SparkSession, rounds: int, many: int, seed: int, clusters: int, groups: int) -> DataFrame:
    """(_block, _group, replicate, at, times): of each replicate's draws, made once, how often each number of a block fell; numbers by the
    steps between them, both squeezed. A slice of draws begins anywhere in the generator's sequence by a jump."""
    per = -(-many // DRAWS)

    def run(batches):
        for b in batches:
            for s in b.column("id").to_pylist():
                r, first = s // per, s % per * DRAWS
                drawn, times = np.unique(lcg_draws(seed, r * many + first, min(DRAWS, many - first), many), return_counts=True)
                cut = np.searchsorted(drawn, np.arange(0, many + clusters, clusters))
                on = np.flatnonzero(np.diff(cut))
                at = [zlib.compress(np.diff(drawn[cut[k] : cut[k + 1]], prepend=k * clusters).astype(np.uint32).tobytes(), 1) for k in on]
                n = [zlib.compress(times[cut[k] : cut[k + 1]].astype(np.uint32).tobytes(), 1) for k in on]
                yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(np.full(len(on), r % groups)), pa.array(np.full(len(on), r)), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["_block", "_group", "replicate", "at", "times"])

    slices = rounds * per
    parts = max(1, min(slices, spark.sparkContext.defaultParallelism * 4, -(-rounds * many // DRAWS) * 4))
    return spark.range(0, slices, 1, parts).mapInArrow(run, "_block long, _group long, replicate long, at binary, times binary")


def clustered_bootstrap(cells: DataFrame, spark: SparkSession, rounds: int = C.BOOTSTRAP_ROUNDS, seed: int = C.BOOTSTRAP_SEED, clusters: int = CLUSTERS) -> DataFrame:
    """(replicate, rr): standardized risk ratios over clusters drawn with replacement.

    cells: (cluster, stratum, n, k1, n1, k0, n0) as of clustered_cells. A replicate draws as many clusters as there are, by their
    number in order. Every draw is made once, by some task; the counts by replicate and block of CLUSTERS clusters travel to the
    block's cells, of which each group of rounds has a copy. So the work follows draws and cells, not their product.
    """
    numbers = numbered_keys(cells, "cluster", "_i")
    own = store(cells.join(numbers, "cluster").withColumn("_block", F.floor(F.col("_i") / clusters)), "cells")
    n = own.agg(F.max("_i")).first()[0]
    many = 0 if n is None else n + 1
    groups = min(GROUPS, rounds)
    kind = cells.schema["stratum"].dataType.simpleString()
    shape = f"replicate long, stratum {kind}, k1 double, n1 double, k0 double, n0 double"

    def run(key, t, drawn):
        first = int(key[0]) * clusters
        _, at, s = np.unique(t["stratum"].to_numpy(), return_index=True, return_inverse=True)
        names = t["stratum"].to_numpy()[at]
        which, counts, out = t["_i"].to_numpy() - first, t[["k1", "n1", "k0", "n0"]].to_numpy(np.float64), []
        for r, parts in drawn.groupby("replicate") if len(t) else ():
            times = np.zeros(clusters, np.int64)
            for steps, fell in zip(parts["at"], parts["times"], strict=True):
                times[np.cumsum(np.frombuffer(zlib.decompress(steps), np.uint32).astype(np.int64))] += np.frombuffer(zlib.decompress(fell), np.uint32)
            sums = [np.bincount(s, counts[:, i] * times[which], len(names)) for i in range(4)]
            out.append(pd.DataFrame({"replicate": r, "stratum": names, **dict(zip(("k1", "n1", "k0", "n0"), sums, strict=True))}))
        return pd.concat(out) if out else pd.DataFrame(columns=["replicate", "stratum", "k1", "n1", "k0", "n0"])

    if not many:
        return spark.createDataFrame([], "replicate long, rr double")
    dealt = own.withColumn("_group", F.explode(F.expr(f"sequence(0L, {groups - 1}L)"))).groupBy("_block", "_group")
    sums = dealt.cogroup(_draw_counts(spark, rounds, many, seed, clusters, groups).groupBy("_block", "_group")).applyInPandas(run, shape)
    sums = sums.groupBy("replicate", "stratum").agg(*[F.sum(c).alias(c) for c in ("k1", "n1", "k0", "n0")])
    weights = own.groupBy("stratum").agg(F.sum("n").alias("w"))
    on = (F.col("n1") > 0) & (F.col("n0") > 0)
    arm = lambda k, m: F.sum(F.when(on, F.col("w") * F.col(k) / F.nullif(F.col(m), F.lit(0.0))))
    per = sums.join(weights, "stratum").groupBy("replicate").agg(arm("k1", "n1").alias("p1"), arm("k0", "n0").alias("p0"))
    return per.select("replicate", F.coalesce(F.col("p1") / F.nullif(F.col("p0"), F.lit(0.0)), F.lit(float("nan"))).alias("rr"))


def clustered_cells(df: DataFrame, cluster: str, stratum: str, exposed: Column, outcome: Column) -> DataFrame:
    """The sparse cells of each cluster."""
    x, y = exposed.cast("long"), outcome.cast("long")
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), F.sum(x * y).alias("k1"), F.sum(x).alias("n1"), F.sum((1 - x) * y).alias("k0"), F.sum(1 - x).alias("n0"))


def percentile_interval(replicates: DataFrame, value: str = "rr") -> DataFrame:
    """One row: elements int(.025 n) and int(.975 n) - 1 of the sorted replicates that aren't NaN."""
    a = replicates.where(~F.isnan(value)).agg(F.sort_array(F.collect_list(value)).alias("v"))  # a number a replicate
    n = F.size("v")
    return a.select(n.alias("n"), F.try_element_at("v", F.floor(n * 0.025).cast("int") + 1).alias("low"), F.try_element_at("v", F.floor(n * 0.975).cast("int")).alias("high"))


def _rounds(groups: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group")


#: numpy draws without replacement from fewer items than this; and shuffles no more than so many one by one.
NUMPY_ITEMS, SHUFFLED = 10**9, 10**8


def _log_gamma_step(a: float, d: float) -> float:
    """lgamma(a + d) - lgamma(a), without the loss of digits that large values have."""
    if min(a, a + d) < 50:
        return math.lgamma(a + d) - math.lgamma(a)
    tail = lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return (a - 0.5) * math.log1p(d / a) + d * math.log(a + d) - d + tail(a + d) - tail(a)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without replacement, from any numbers. Beyond numpy's, by rejection under a bell that lies over the
    distribution (ratio of uniforms), so draws follow it and not a normal curve."""
    if good + bad < NUMPY_ITEMS:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    if 2 * n > total:  # those that are left instead
        return good - hypergeometric(rng, good, bad, total - n)
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    if min(good, n) < 1000:  # few: one after the other
        left, hits = good, 0
        small, other = (n, good) if n <= good else (good, n)
        left = other
        for k in range(small):
            if rng.random() * (total - k) < left:
                left, hits = left - 1, hits + 1
        return hits
    mode = (n + 1) * (good + 1) // (total + 2)
    mean, spread = n * good / total, math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)  # fixed values of the method

    def log_ratio(k: int) -> float:
        """log of the chance of k over that of the mode."""
        d = k - mode
        return -(_log_gamma_step(mode + 1, d) + _log_gamma_step(good - mode + 1, -d) + _log_gamma_step(n - mode + 1, -d) + _log_gamma_step(bad - n + mode + 1, d))

    while True:
        u, v = rng.random(), rng.random()
        if not u:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if 0 <= k <= min(good, n) and 2 * math.log(u) <= log_ratio(k):
            return k


def permuted_hits(rng: np.random.Generator, labels: np.ndarray, targets: np.ndarray) -> int:
    """Hits of one random permutation of a stratum, from how many items have each value as label and as target. Of few values and many
    items, each target's labels are drawn without replacement; else the labels themselves are shuffled. Both are exact, for any
    number of items."""
    n = int(labels.sum())
    if len(labels) ** 2 > 4 * n and n <= SHUFFLED:
        return int((rng.permutation(np.repeat(np.arange(len(labels)), labels)) == np.repeat(np.arange(len(targets)), targets)).sum())
    left, hits = labels.copy(), 0
    for v in np.flatnonzero(targets).tolist():
        if left.sum() < NUMPY_ITEMS:
            got = rng.multivariate_hypergeometric(left, int(targets[v]))
        else:
            got, rest, need = np.zeros_like(left), int(left.sum()), int(targets[v])
            for c in np.flatnonzero(left).tolist():
                rest -= int(left[c])
                got[c] = hypergeometric(rng, int(left[c]), rest, need) if rest else need
                need -= int(got[c])
        hits += int(got[v])
        left -= got
    return hits


def permutation_null(spark: SparkSession, hits: DataFrame, rounds: int, seed: int) -> DataFrame:
    """One row: observed hits, permutable strata, and p = (null >= observed + 1) / (n + 1).

    hits: (item, stratum, label, target): a hit is target = label. Labels are shuffled within strata (one constant stratum for a
    free permutation). A stratum with one distinct label can't be permuted and its p says nothing: see `permutable`. Strata
    travel as counts of their labels and targets, so a large one is no larger than its values are many.
    """
    hits = store(hits.select("stratum", F.col("label").cast("string").alias("label"), F.col("target").cast("string").alias("target")), "hits")
    side = lambda c, a, b: hits.select("stratum", F.col(c).alias("value"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    margins = side("label", 1, 0).unionAll(side("target", 0, 1)).groupBy("stratum", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    groups = min(GROUPS, rounds)

    def run(key, t):
        group = int(key[1])
        t = t.sort_values("value")
        a, b, salt = t["a"].to_numpy(np.int64), t["b"].to_numpy(np.int64), zlib.crc32(str(key[0]).encode())
        ids = list(range(group, rounds, groups))
        return pd.DataFrame({"id": ids, "hits": [permuted_hits(np.random.default_rng([seed, r, salt]), a, b) for r in ids]})

    per = margins.select("*", _rounds(groups)).groupBy("stratum", "_group").applyInPandas(run, "id long, hits long").groupBy("id").agg(F.sum("hits").alias("hits"))
    seen = hits.agg(F.coalesce(F.sum((F.col("label") == F.col("target")).cast("long")), F.lit(0)).alias("observed"))
    strata = margins.where("a > 0").groupBy("stratum").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") >= 2).cast("long")), F.lit(0)).alias("permutable"))
    both = per.crossJoin(F.broadcast(seen))  # one row
    null = both.agg(F.avg("hits").alias("null_mean"), ((F.sum((F.col("hits") >= F.col("observed")).cast("long")) + 1) / (F.count("*") + 1)).alias("p"))
    return seen.crossJoin(strata).crossJoin(null)  # one row each


def placebo(rows: DataFrame, pool: DataFrame, rounds: int, seed: int, stratum: str = "len", value: str = "breadth", bin_: str = "bin") -> DataFrame:
    """(draw, difference): the stratum-standardized mean of the last bin less that of the first, when every row gets the bin of a random
    member of `pool` (one column, the bin).

    Rows with one stratum and value are alike, so each such cell deals its rows to bins at once, by a multinomial draw with the
    pool's shares: the distribution is that of dealing them one by one.
    """
    shares = pool.groupBy(bin_).agg(F.count("*").alias("n")).orderBy(bin_).collect()  # a row a bin
    bins, share = [r[bin_] for r in shares], np.array([r.n for r in shares], np.float64)
    share /= share.sum() or 1
    if not bins:
        return rows.sparkSession.createDataFrame([], "draw long, difference double")
    groups = min(GROUPS, rounds)
    cells = rows.groupBy(F.col(stratum).alias("stratum"), F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))

    def run(key, t):
        group, salt = int(key[1]), zlib.crc32(str(key[0]).encode())
        t = t.sort_values("value")
        n, v, out = t["n"].to_numpy(np.int64), t["value"].to_numpy(), []
        for r in range(group, rounds, groups):
            dealt = np.random.default_rng([seed, r, salt]).multinomial(n, share)
            out.append(pd.DataFrame({"draw": r, "b": np.arange(len(bins)), "n": dealt.sum(0), "s": v @ dealt, "w": n.sum()}))
        return pd.concat(out)

    per = cells.select("*", _rounds(groups)).groupBy("stratum", "_group").applyInPandas(run, "draw long, b long, n long, s double, w long").where("n > 0")
    means = per.groupBy("draw", "b").agg((F.sum(F.col("w") * F.col("s") / F.col("n")) / F.sum("w")).alias("mean"))
    return means.groupBy("draw").agg((F.max_by("mean", "b") - F.min_by("mean", "b")).alias("difference"))


def decoy_swap(items: DataFrame, hits: DataFrame, family: DataFrame, rounds: int, seed: int) -> DataFrame:
    """One row: items whose parent has a family, those of them that lie in their true parent, and the same when a random member of the
    family stands for it: null_mean, null_max, p.

    items: (item, parent); hits: (item, gene); family: (parent, gene). An item's chance is the share of the family that it lies
    in; items of one chance are drawn together, a binomial draw each, which is what drawing for each item gives.
    """
    size = family.distinct().groupBy("parent").agg(F.count("*").alias("m"))
    own = items.join(size, "parent")
    found = own.join(family.distinct(), "parent").join(hits.distinct(), ["item", "gene"]).groupBy("item").agg(F.count("*").alias("k"))
    per = store(own.join(found, "item", "left").join(hits.distinct().select("item", F.col("gene").alias("parent"), F.lit(1).alias("true")), ["item", "parent"], "left").select("m", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("true", F.lit(0)).alias("true")), "swaps")
    seen = per.agg(F.count("*").alias("n"), F.coalesce(F.sum("true"), F.lit(0)).alias("observed"))
    groups = min(GROUPS, rounds)

    def run(key, t):
        k, m, group = (int(x) for x in key)
        n = int(t["n"].sum())
        ids = list(range(group, rounds, groups))
        return pd.DataFrame({"id": ids, "c": [int(np.random.default_rng([seed, r, k, m]).binomial(n, k / m)) for r in ids]})

    counts = per.groupBy("k", "m").agg(F.count("*").alias("n")).select("*", _rounds(groups))
    null = counts.groupBy("k", "m", "_group").applyInPandas(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).crossJoin(F.broadcast(seen))  # one row
    null = null.agg(F.avg("c").alias("null_mean"), F.max("c").alias("null_max"), ((F.sum((F.col("c") >= F.col("observed")).cast("long")) + 1) / (F.count("*") + 1)).alias("p"))
    return seen.crossJoin(null)  # one row each


def shuffled(c: Column, seed: int) -> Column:
    """The letters of a text in an order that a hash of seed, text and place gives: the same wherever the row lies."""
    letters = F.transform(F.split(c, ""), lambda x, i: F.struct(F.xxhash64(F.lit(seed), c, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.concat_ws("", F.transform(F.array_sort(letters), lambda s: s["x"]))


def uniform(c: Column, seed: int, weights: dict[str, int]) -> Column:
    """A text as long, of random letters in proportion to `weights`, by a hash of seed, text and place."""
    letters, total, upto = sorted(weights), sum(weights.values()), 0
    cuts = []
    for x in letters:
        upto += weights[x]
        cuts.append(F.lit(upto))
    place = lambda i: F.size(F.filter(F.array(*cuts), lambda y: y <= F.pmod(F.xxhash64(F.lit(seed), c, i), F.lit(total)))) + 1
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.element_at(F.array(*[F.lit(x) for x in letters]), place(i))))


def letter_weights(df: DataFrame, sequence: str) -> dict[str, int]:
    """How often each letter occurs in all sequences."""
    return {r.x: r.n for r in df.select(F.explode(F.split(sequence, "")).alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()}  # a row a letter


def effective_rho(spectra: DataFrame, noncanonical: str, canonical: str, t: float) -> DataFrame:
    """One row: expected accepted noncanonical over canonical decoys when a spectrum with m candidates is accepted with probability
    1 - (1 - t)^m; rho_global is what their totals would say."""
    n, c = F.col(noncanonical).cast("double"), F.col(canonical).cast("double")
    w = (1 - F.pow(F.lit(1.0 - t), n + c)) / F.nullif(n + c, F.lit(0.0))
    return spectra.agg((F.sum(w * n) / F.nullif(F.sum(w * c), F.lit(0.0))).alias("rho_eff"), (F.sum(n) / F.nullif(F.sum(c), F.lit(0.0))).alias("rho_global"))


def simulated_rho(spectra: DataFrame, noncanonical: str, canonical: str, t: float, reps: int, seed: int) -> DataFrame:
    """R11, the check: accepted decoys of each kind over `reps` draws for each spectrum. Draws of one spectrum are alike, so their counts are
    binomial."""
    def run(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            n, c = b["n"].to_numpy(np.float64), b["c"].to_numpy(np.float64)
            taken = rng.binomial(reps, 1 - (1 - t) ** (n + c))
            of_n = rng.binomial(taken, n / np.maximum(1, n + c))
            yield pd.DataFrame({"dn": [int(of_n.sum())], "dc": [int((taken - of_n).sum())]})

    per = spectra.select(F.col(noncanonical).cast("long").alias("n"), F.col(canonical).cast("long").alias("c")).mapInPandas(run, "dn long, dc long")
    return per.agg(F.sum("dn").alias("dn"), F.sum("dc").alias("dc"))
