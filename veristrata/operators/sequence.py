"""K-mers and containment joins (J1-J12, A8-A11, A15, A17, A25, P28, U1-U4). No substring join is ever a nested loop: windows or seeds make it equi."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators import kmers
from veristrata.plans.checkpoint import store


#: Characters of the pieces that long texts are read in: a place in a string is found from its start, so whole texts would cost
#: the square of their length.
SEGMENT = 512
#: Bytes of query sequences up to which every task holds them all; beyond, they are shuffled by seed.
HELD_BYTES = 32 << 20
#: Query lengths up to which one window of each length is made; with more, sequences are found by seeds.
LENGTHS = 64
#: The farthest that seeds of references are apart.
STEP = 64
#: Tests that a window's hash passes before the window is sent: of those that are no query, one in 16 passes each.
PROBES = 3

_BASE = 0x9E3779B97F4A7C15


def segments(df: DataFrame, text: str, keep: list[str], overlap: int, size: int = SEGMENT, lead: int = 0) -> DataFrame:
    """(keep..., base, text): pieces that start every `size` characters and reach `overlap` characters further, and `lead` back where the
    text has them."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    back = lambda i: F.least(i, F.lit(lead))
    cut = F.transform(starts, lambda i: F.struct(i.alias("base"), F.substr(F.col(text), i + 1 - back(i), back(i) + (size + overlap)).alias("piece")))
    return df.where(F.col(text).isNotNull()).select(*keep, F.explode(cut).alias("_x")).select(*keep, F.col("_x.base").alias("base"), F.col("_x.piece").alias(text))


def _substrings(text: str, k: int) -> Column:
    n = F.length(text)
    return F.when(n >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substr(F.col(text), i, F.lit(k)))))


def windows(df: DataFrame, text: str, lengths: list[int], keep: list[str]) -> DataFrame:
    """(keep..., window, length): all substrings of the given lengths, at least once for each row of df that has them."""
    none = F.array().cast("array<string>")
    made = F.concat(*[F.coalesce(_substrings(text, k), none) for k in sorted(set(lengths))])
    out = segments(df, text, keep, max(lengths) - 1).select(*keep, F.explode(made).alias("window"))
    return out.withColumn("length", F.length("window"))


def lengths_of(queries: DataFrame, sequence: str, most: int = LENGTHS) -> list[int] | None:
    """The lengths that occur among the queries; None if there are more than `most`."""
    found = [r[0] for r in queries.where(F.col(sequence) != "").select(F.length(sequence)).distinct().limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def contained(queries: DataFrame, refs: DataFrame, sequence: str = "seq", text: str = "text", lengths: list[int] | None = None) -> DataFrame:
    """The distinct query sequences that are a substring of some reference."""
    lengths = lengths if lengths is not None else lengths_of(queries, sequence)
    q = queries.select(sequence).where(F.col(sequence) != "").distinct()
    if lengths is None:
        return _seeded(q, refs, [], sequence, text).select(sequence).distinct()
    if not lengths:
        return q.limit(0)
    w = windows(refs.where(F.col(text).isNotNull()), text, lengths, []).select(F.col("window").alias(sequence)).distinct()
    return q.join(w, sequence, "left_semi")


def _seeded(queries: DataFrame, refs: DataFrame, keep: list[str], sequence: str, text: str) -> DataFrame:
    """seed_matches for queries of very many lengths: a seed of the shortest length there is."""
    least = queries.where(F.col(sequence) != "").agg(F.min(F.length(sequence))).first()[0] or 1
    return seed_matches(queries, refs, keep, least, sequence, text)


def collapse_il(c: Column) -> Column:
    """I and L are one residue."""
    return F.translate(c, "I", "L")


def matches(queries: DataFrame, refs: DataFrame, keep: list[str], sequence: str = "seq", text: str = "text", lengths: list[int] | None = None) -> DataFrame:
    """(sequence, keep...) for each reference row that holds the sequence."""
    lengths = lengths if lengths is not None else lengths_of(queries, sequence)
    if lengths is None:
        return _seeded(queries, refs, keep, sequence, text)
    w = windows(refs.where(F.col(text).isNotNull()), text, lengths or [1], keep).drop("length").withColumnRenamed("window", sequence)
    return queries.select(sequence).distinct().join(w, sequence)


def seed_matches(queries: DataFrame, refs: DataFrame, keep: list[str], seed: int, sequence: str = "seq", text: str = "text", by: list[str] | None = None) -> DataFrame:
    """J6, J8, J12, and with `by` J9: distinct (sequence, by..., keep...) of references that hold the sequence, found by a seed of its
    first `seed` characters; lengths may be anything from seed on. by: columns of both sides that must be equal.

    Where all queries are longer than the seed, the seeds of references are taken some letters apart, as far as the shortest query
    still covers one, and each query is known by all its seeds in that stretch. References are read in pieces that overlap by
    the longest query, so a candidate is checked within its piece. Up to HELD_BYTES of queries with their seeds, every task
    holds them and nothing of the references is shuffled before it matches. More queries meet the references' seeds in a
    shuffle, without the pieces, and pieces come back where a seed hit.

    Where such seeds would be shuffled, or taken at every letter, queries of up to LENGTHS lengths are found whole instead, by
    the hash of each window of their lengths: see _hash_join.
    """
    by = by or []
    q = store(queries.where(F.length(sequence) >= seed).select(sequence, *by).distinct(), "seed-queries")  # made once, read for its sizes and the join
    size = q.agg(F.sum(F.length(sequence) + 40 * (1 + len(by))).alias("bytes"), F.min(F.length(sequence)).alias("shortest"), F.max(F.length(sequence)).alias("longest")).first()
    step = min(STEP, (size.shortest or seed) - seed + 1)
    held = (size.bytes or 0) * step <= HELD_BYTES
    if step == 1 or not held:
        lengths = [r[0] for r in q.select(F.octet_length(sequence)).distinct().limit(LENGTHS + 1).collect()]
        if len(lengths) <= LENGTHS:
            return _hash_join(q, refs, list(dict.fromkeys([*by, *keep])), sorted(lengths), sequence, text, by, held)
    return _seed_join(q, refs, keep, seed, step, sequence, text, by, size.longest or seed, held)


def _hashed(data: np.ndarray, lengths: list[int]):
    """(first place, length, hash of the bytes from each place on) for each length, PLACES places at a time; the last ones reach past the end."""
    most = max(lengths)
    up = np.cumprod(np.full(kmers.PLACES + most, _BASE, np.uint64))
    down = np.cumprod(np.full(kmers.PLACES, pow(_BASE, -1, 1 << 64), np.uint64))
    for low in range(0, len(data), kmers.PLACES):
        own = data[low : low + kmers.PLACES + most]
        n = min(kmers.PLACES, len(data) - low)
        sums = np.zeros(n + most + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], out=sums[1 : len(own) + 1])
        for k in lengths:
            yield low, k, (((sums[k : k + n] - sums[:n]) * down[:n]) ^ np.uint64(k)).view(np.int64)


def _probe(v: np.ndarray, i: int) -> np.ndarray:
    return v if i == 0 else kmers._mix(v + i).view(np.int64)


def _hash_join(q: DataFrame, refs: DataFrame, cols: list[str], lengths: list[int], sequence: str, text: str, by: list[str], held: bool) -> DataFrame:
    """Distinct (sequence, cols...): each window of the queries' lengths whose hash passes a bit filter of all queries is sent, once for
    equal cols of a batch, and meets the queries by its bytes. What is sent follows what is found, not the references."""

    def hashes(batches):
        for b in batches:
            data, offs = kmers._buffers(b.column(sequence))
            size = np.diff(offs)
            for low, k, v in _hashed(data, lengths):
                at = offs[:-1][(size == k) & (offs[:-1] >= low) & (offs[:-1] < low + len(v))] - low
                for i in range(PROBES):
                    yield pa.RecordBatch.from_arrays([pa.array(_probe(v[at], i))], ["kmer"])

    known = kmers.Bits(q.select(sequence).distinct().mapInArrow(hashes, "kmer long"), PROBES * q.count()) if lengths else None
    t = refs.where(F.col(text).isNotNull()).select(*cols, F.col(text).cast("string").alias("_text"))

    def passing(batches):
        for b in batches:
            data, offs = kmers._buffers(b.column("_text"))
            own = np.zeros(b.num_rows, np.int64)  # rows of equal cols have one number
            for c in cols:
                nested = pa.types.is_nested(b.column(c).type)
                code = np.arange(b.num_rows) if nested else b.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                own = np.unique(own * b.num_rows + code, return_inverse=True)[1]
            for low, k, v in _hashed(data, lengths):
                on = np.flatnonzero(known.passes(v))
                for i in range(1, PROBES):
                    on = on[known.passes(_probe(v[on], i))]
                row = np.searchsorted(offs, on + low, "right") - 1
                inside = offs[row + 1] - (on + low) >= k
                on, row = on[inside], row[inside]
                order = np.lexsort((v[on], own[row]))
                on, row = on[order], row[order]
                new = np.full(len(on), True)
                again = 1 + np.flatnonzero((v[on][1:] == v[on][:-1]) & (own[row][1:] == own[row][:-1]))
                some = max(1, kmers.PLACES // k)  # windows whose bytes are looked at together
                for i in range(0, len(again), some):
                    at = again[i : i + some]
                    new[at] = (data[(on[at] + low)[:, None] + np.arange(k)] != data[(on[at - 1] + low)[:, None] + np.arange(k)]).any(1)
                on, row = on[new] + low, row[new]
                for i in range(0, len(on), some):
                    at = on[i : i + some]
                    offsets, found = (np.arange(len(at) + 1) * k).astype(np.int32), data[(at[:, None] + np.arange(k)).ravel()]
                    windows_ = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(found)])
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row[i : i + some])) for c in cols], windows_], [*cols, "_seq"])

    from pyspark.sql import types as T

    own = q.withColumn("_seq", F.col(sequence).cast("binary"))
    if not lengths:
        return own.join(t.drop("_text").limit(0), by or None, "inner").select(sequence, *cols)
    schema = T.StructType([*[T.StructField(c, t.schema[c].dataType) for c in cols], T.StructField("_seq", T.BinaryType())])
    found = t.mapInArrow(passing, schema).distinct()
    return found.join(F.broadcast(own) if held else own, [*by, "_seq"]).select(sequence, *cols)

def _seed_join(q: DataFrame, refs: DataFrame, keep: list[str], seed: int, step: int, sequence: str, text: str, by: list[str], longest: int, held: bool) -> DataFrame:
    n, size = F.length(text), -(-max(SEGMENT, longest) // step) * step
    cols = list(dict.fromkeys([*by, *keep]))
    pieces = segments(refs, text, cols, longest - 1, size, step - 1)
    head = F.least("base", F.lit(step - 1))  # letters of the piece before its own first place
    last = F.least(head + size, n - (seed - 1))
    places = F.transform(F.sequence(head + 1, F.greatest(last, head + 1), F.lit(step)), lambda i: F.struct(i.alias("at"), F.substr(F.col(text), i, F.lit(seed)).alias("seed")))
    seeds = F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda o: F.struct(o.alias("_off"), F.substr(F.col(sequence), o + 1, F.lit(seed)).alias("_seed")))
    q = q.select(sequence, *by, F.explode(seeds).alias("_s")).select(sequence, *by, "_s.*")
    start = F.col("_x.at") - F.col("_off")
    fits = (start >= 1) & (F.substr(F.col(text), start, F.length(sequence)) == F.col(sequence))
    if held:
        at = pieces.select(*cols, text, F.explode(places).alias("_x")).withColumn("_seed", F.col("_x.seed"))
        return at.join(F.broadcast(q), [*by, "_seed"]).where(fits).select(sequence, *cols).distinct()
    at = pieces.select(*cols, "base", F.explode(places).alias("_x")).withColumn("_seed", F.col("_x.seed"))
    near = at.join(q, [*by, "_seed"]).select(sequence, *cols, "base", "_x", "_off")
    return near.join(pieces, [*cols, "base"]).where(fits).select(sequence, *cols).distinct()


def in_own_group(queries: DataFrame, refs: DataFrame, group: str, sequence: str = "seq", text: str = "text", seed: int | None = None) -> DataFrame:
    """(sequence, group, own): whether a reference of the same group holds the sequence: short ones as packed k-mers, longer
    ones and those of other characters by seeds within the group. An empty sequence is in no reference."""
    q = store(queries.select(sequence, group).distinct(), "group-queries")
    own = kmers.held_by_group(q, refs, group, sequence, text)
    rest = q.where(~F.col(sequence).rlike(kmers.SHORT) & (F.col(sequence) != ""))
    least = seed or rest.agg(F.min(F.length(sequence))).first()[0]
    if least and not rest.isEmpty():
        own = own.unionAll(seed_matches(rest, refs.where(F.col(group).isNotNull()), [], least, sequence, text, [group]).select(sequence, group))
    return q.join(own.withColumn("own", F.lit(True)), [sequence, group], "left").withColumn("own", F.coalesce("own", F.lit(False)))


def gene_level(found: DataFrame, gene: str, own: str = "own") -> DataFrame:
    """One row: genes with a sequence that matches something, and those of which one lies in the gene's own references."""
    per = found.groupBy(gene).agg(F.bool_or(own).alias("_own"))
    return per.agg(F.count("*").alias("genes"), F.coalesce(F.sum(F.col("_own").cast("long")), F.lit(0)).alias("own"))


def frame_audit(found: DataFrame, coding: DataFrame, gene: str, is_self: str, own: str = "own") -> DataFrame:
    """A10: (is_self, n, coding, own): sequences whose gene has references at all, and those that lie in them, by self or not."""
    t = found.join(coding.select(gene).distinct().withColumn("_coding", F.lit(1)), gene, "left")
    return t.groupBy(is_self).agg(F.count("*").alias("n"), F.count("_coding").alias("coding"), F.sum(F.col(own).cast("long")).alias("own"))


def self_fraction(accepted: DataFrame, refs: DataFrame, skip: tuple[str, ...] = ("canonical", "variant"), group: str = "class", peptide: str = "peptide", decoy: str = "is_decoy", text: str = "text") -> DataFrame:
    """(class, n_target_peptides, canonical_self, canonical_self_frac) of the distinct accepted target peptides of each class that isn't
    in `skip`."""
    seq = F.upper(F.col(peptide)).alias("_seq")
    t = accepted.where(~F.col(group).isin(list(skip)) & ~F.col(decoy) & (F.coalesce(F.col(peptide), F.lit("")) != "")).select(group, seq).distinct()
    both = flagged(t, contained(t, refs, "_seq", text), "_seq", "_self")
    per = both.groupBy(group).agg(F.count("*").alias("n_target_peptides"), F.sum(F.col("_self").cast("long")).alias("canonical_self"))
    return per.withColumn("canonical_self_frac", F.round(F.col("canonical_self") / F.col("n_target_peptides"), 4))


def in_band(c: Column, low: int = 8, high: int = 11) -> Column:
    """P28."""
    return F.length(c).between(low, high)


def minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def union_interval(counts: DataFrame, grid: list[int]) -> DataFrame:
    """Bounds of the hit rate if m more k-mers were in the library, and the ceiling where all headroom is used."""
    u, h, c = F.col("u"), F.col("h"), F.col("n_canon")
    m = F.col("m")
    top = F.nullif(u + m, F.lit(0))
    return counts.select("u", "h", "n_canon", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in grid])).alias("m")).select(
        "m", (h / top).alias("low"), ((h + F.least(m, c - h)) / top).alias("high"), (c / F.nullif(u + c - h, F.lit(0))).alias("ceiling"), (c - h).alias("headroom")
    )


def breadth(occurrences: DataFrame, sequence: str = "seq", tissue: str = "tissue") -> DataFrame:
    """Distinct tissues of each sequence."""
    return occurrences.groupBy(sequence).agg(F.count_distinct(tissue).alias("breadth"))


def flagged(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Df with whether its key is among keys (a semi join as a flag)."""
    return df.join(keys.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def reference_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both, only in a, only in b."""
    t = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return t.agg(n(F.col("a").isNotNull() & F.col("b").isNotNull(), "both"), n(F.col("b").isNull(), "only_a"), n(F.col("a").isNull(), "only_b"))


def catalogue_union(*parts: DataFrame) -> DataFrame:
    """U4: concatenation of sources with different columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sequence_union(*parts: DataFrame, key: str = "seq") -> DataFrame:
    """The distinct keys of several catalogues."""
    out = parts[0].select(key)
    for p in parts[1:]:
        out = out.unionAll(p.select(key))
    return out.distinct()
