"""Packed k-mers: windows of letters as numbers, five bits a letter, so strings never travel.

A k-mer is a window of k letters A-Z (k is 12 at most); a window that holds any other character is none. Null and short texts
have none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.plans.checkpoint import store

#: Places that are looked at together.
PLACES = 1 << 20
#: (k-mer, member) entries of an index that every task holds (16 bytes each); a larger one meets the pool in a shuffle.
HELD = 2 << 20
#: Bits of the filter before that shuffle for each k-mer of the index, and its largest size.
BITS, MOST_BITS = 16, 1 << 27
#: Rows of one k-mer in that shuffle from which they are dealt to several parts.
HEAVY = 100_000
#: Letters whose k-mers are merged in one part.
LETTERS = 8_000_000

_CODE = np.zeros(256, np.int64)
_CODE[65:91] = np.arange(1, 27)


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_string()).fill_null("")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8), o - o[0]


def windows(col: pa.Array, lengths: list[int]):
    """(k, k-mers, row of each) of a column of texts, for each k of `lengths`, PLACES places at a time."""
    data, offs = _buffers(col)
    most = max(lengths, default=0)
    for low in range(0, len(data) if most else 0, PLACES):
        n = min(PLACES, len(data) - low)
        c = _CODE[data[low : low + n + most - 1]]
        c = np.append(c, np.zeros(n + most - 1 - len(c), np.int64))
        odd = np.append(0, np.cumsum(c == 0))
        start = np.arange(low, low + n)
        row = np.searchsorted(offs, start, "right") - 1
        left = offs[row + 1] - start
        v = np.zeros(n, np.int64)
        for k in range(1, most + 1):
            v = (v << 5) | c[k - 1 : k - 1 + n]
            if k in lengths:
                ok = (odd[k : k + n] == odd[:n]) & (left >= k)
                yield k, v[ok], row[ok]


def _check(k: int) -> None:
    if not 1 <= k <= 12:
        raise ValueError("a packed k-mer has 1 to 12 letters")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xBF58476D1CE4E5B9)


# ---- sizes of sets of k-mers, by sorted runs --------------------------------------------------------------------------


def _squeeze(a: np.ndarray) -> bytes:
    """A sorted run, by its steps."""
    return zlib.compress(np.diff(a, prepend=0).astype(np.int64).tobytes(), 1)


def _stretch(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), np.int64))


def library_sizes(texts: list[DataFrame], k: int, text: str = "text") -> DataFrame:
    """One row for each combination `tags` (bit i: in the i-th of texts) that some k-mer has: (tags, n): how many distinct k-mers do.

    A task sends its distinct k-mers as one sorted, squeezed run a part; a part merges its runs. Parts follow the letters, and a
    k-mer is at most once in a run, so a common one weighs no more than others.
    """
    _check(k)
    every = None
    for i, t in enumerate(texts):
        own = t.select(F.col(text).alias("text"), F.lit(i).alias("i"))
        every = own if every is None else every.unionAll(own)
    letters = every.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-letters // LETTERS))

    def run(batches):
        held, size = {}, 0

        def out():
            for i, pieces in held.items():
                v = np.unique(np.concatenate(pieces))
                part = (_mix(v) >> np.uint64(32)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(p, i, _squeeze(v[order[cut[p] : cut[p + 1]]])) for p in np.flatnonzero(np.diff(cut))]
                for at in range(0, len(rows), 500):
                    p, tags, runs = zip(*rows[at : at + 500], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(tags, pa.int32()), pa.array(runs, pa.binary())], ["part", "i", "run"])
            held.clear()

        for b in batches:
            of = b.column("i").to_numpy()
            for _, v, row in windows(b.column("text"), [k]):
                for i in np.unique(of[row]):
                    own = np.unique(v[of[row] == i])
                    held.setdefault(int(i), []).append(own)
                    size += len(own)
                if size > 4 * PLACES:
                    yield from out()
                    size = 0
        yield from out()

    def merge(key, t):
        i = t.column("i").to_numpy()
        sets = [np.unique(np.concatenate([_stretch(r) for r, own in zip(t.column("run").to_pylist(), i, strict=True) if own == which])) for which in np.unique(i)]
        v = np.concatenate(sets)
        tags = np.concatenate([np.full(len(s), 1 << int(which)) for s, which in zip(sets, np.unique(i), strict=True)])
        order = np.argsort(v, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(v[order]) != 0))
        kinds, n = np.unique(np.add.reduceat(tags[order], first), return_counts=True)
        return pa.table({"tags": pa.array(kinds, pa.int32()), "n": pa.array(n, pa.int64())})

    runs = every.mapInArrow(run, "part long, i int, run binary")
    return runs.groupBy("part").applyInArrow(merge, "tags int, n long").groupBy("tags").agg(F.sum("n").alias("n"))


def library_union(a: DataFrame, b: DataFrame, canon: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Sizes of the k-mer sets of two libraries, their union by inclusion and exclusion, and the same of the part in canon. Rows
    are texts."""
    sizes = library_sizes([a, b, canon], k, text)
    has = lambda *bits: F.coalesce(F.sum(F.when(F.col("tags").bitwiseAND(sum(1 << i for i in bits)) == sum(1 << i for i in bits), F.col("n"))), F.lit(0))
    one = sizes.agg(has(0).alias("n_a"), has(1).alias("n_b"), has(0, 1).alias("n_both"), has(2).alias("n_canon"), has(0, 2).alias("hit_a"), has(1, 2).alias("hit_b"), has(0, 1, 2).alias("hit_both"))
    return one.select("*", (F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("u"), (F.col("hit_a") + F.col("hit_b") - F.col("hit_both")).alias("h"))


# ---- families: texts of a pool that share k-mers with members ---------------------------------------------------------


def _index(members: DataFrame, k: int, member: str, text: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for _, v, row in windows(b.column("text"), [k]):
                pair = np.unique(np.stack([row, v]), axis=1) if len(v) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([b.column("member").take(pa.array(pair[0])), pa.array(pair[1])], ["member", "kmer"])

    t = members.select(F.col(member).alias("member"), F.col(text).alias("text")).where("member is not null")
    return store(t.mapInArrow(run, f"member {dict(t.dtypes)['member']}, kmer long").distinct(), "family-index")


def _counted(rows: np.ndarray, keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, how often, or the sum of n) of each distinct pair."""
    order = np.lexsort((keys, rows))
    r, v = rows[order], keys[order]
    first = np.flatnonzero(np.append(True, (np.diff(r) != 0) | (np.diff(v) != 0))) if len(r) else np.zeros(0, np.int64)
    if n is None:
        return r[first], v[first], np.diff(np.append(first, len(r)))
    return r[first], v[first], np.add.reduceat(n[order], first) if len(first) else n[order]


def family_counts(members: DataFrame, pool: DataFrame, k: int, member: str = "member", ident: str = "gene", text: str = "text", held: int = HELD) -> DataFrame:
    """(member, ident, places): for each text of the pool that is no member itself and each member that it shares k-mers with, the
    places of the text whose k-mer some text of the member has, every place counted. Several texts of an id are added up.

    An index of up to `held` entries is held by every task: nothing of the pool is shuffled but the sums. With a larger one, each
    task sends the k-mers that pass a bit filter of the index's k-mers (of a size that follows the index up to MOST_BITS, beyond
    which it only lets more pass) with their places; k-mers that very many texts have are dealt to several parts by a salt.
    """
    _check(k)
    index = _index(members, k, member, text)
    t = pool.select(F.col(ident).alias("ident"), F.col(text).alias("text")).where("ident is not null and text is not null")
    outside = t.join(members.select(F.col(member).alias("ident")).distinct(), "ident", "left_anti")
    kinds = {"member": dict(index.dtypes)["member"], "ident": dict(t.dtypes)["ident"]}
    n = index.count()
    if n <= held:
        rows = index.orderBy("kmer").toArrow()  # `held` entries at most
        coded = rows.column("member").combine_chunks().dictionary_encode()
        kmers, first = np.unique(rows.column("kmer").to_numpy(), return_index=True)
        shared = pool.sparkSession.sparkContext.broadcast((Near(kmers), kmers, np.append(first, n), coded.indices.to_numpy(), coded.dictionary))

        def look_up(batches):
            near, kmers, cut, codes, names = shared.value
            for b in batches:
                for _, v, row in windows(b.column("text"), [k]) if len(kmers) else ():
                    on = near.has(v)
                    v, row = v[on], row[on]
                    at = np.minimum(np.searchsorted(kmers, v), len(kmers) - 1)
                    hit = kmers[at] == v
                    r, a, places = _counted(row[hit], at[hit])
                    many = cut[a + 1] - cut[a]
                    ends = np.cumsum(many)
                    total = int(ends[-1]) if len(ends) else 0
                    for low in range(0, total, PLACES):  # k-mers of very many members come in pieces
                        i = np.arange(low, min(low + PLACES, total))
                        of = np.searchsorted(ends, i, "right")
                        who = codes[cut[a[of]] + i - (ends[of] - many[of])]
                        rr, ww, sums = _counted(r[of], who, places[of])
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(ww)), b.column("ident").take(pa.array(rr)), pa.array(sums)], ["member", "ident", "places"])

        found = outside.mapInArrow(look_up, f"member {kinds['member']}, ident {kinds['ident']}, places long")
    else:
        found = _by_shuffle(index, n, outside, k, kinds["ident"])
    return found.groupBy("member", "ident").agg(F.sum("places").alias("places")).withColumnsRenamed({"member": member, "ident": ident})


class Near:
    """A quick test that most numbers fail which aren't among some: a flag a hash, as many as fit a processor's cache."""

    def __init__(self, known: np.ndarray):
        self.width = min(24, max(6, (BITS * len(known) - 1).bit_length()))
        self.flags = np.zeros(1 << self.width, bool)
        self.flags[_bit_of(known, self.width)] = True

    def has(self, v: np.ndarray) -> np.ndarray:
        return self.flags[_bit_of(v, self.width)]


class Bits:
    """Which hashes of k-mers an index has: BITS bits for each of its k-mers, MOST_BITS at most."""

    def __init__(self, index: DataFrame, n: int):
        self.width = width = min(MOST_BITS, 1 << max(6, (BITS * n - 1).bit_length())).bit_length() - 1

        def bits(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit_of(b.column("kmer").to_numpy(), width)))], ["bit"])

        word = F.expr("bit_or(shiftleft(CAST(1 AS BIGINT), CAST(bit % 64 AS INT)))")
        words = index.select("kmer").mapInArrow(bits, "bit long").groupBy(F.expr("bit div 64").alias("at")).agg(word.alias("word")).toArrow()  # MOST_BITS at most
        table = np.zeros((1 << width) >> 6, np.uint64)
        table[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
        self.table = index.sparkSession.sparkContext.broadcast(table)

    def passes(self, v: np.ndarray) -> np.ndarray:
        at = _bit_of(v, self.width)
        return (self.table.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _bit_of(v: np.ndarray, width: int) -> np.ndarray:
    return (_mix(v) >> np.uint64(64 - width)).astype(np.int64)


def _by_shuffle(index: DataFrame, n: int, outside: DataFrame, k: int, kind: str) -> DataFrame:
    known = Bits(index, n)

    def passing(batches):
        for b in batches:
            for _, v, row in windows(b.column("text"), [k]):
                on = known.passes(v)
                r, v, places = _counted(row[on], v[on])
                yield pa.RecordBatch.from_arrays([b.column("ident").take(pa.array(r)), pa.array(v), pa.array(places)], ["ident", "kmer", "places"])

    sent = store(outside.mapInArrow(passing, f"ident {kind}, kmer long, places long"), "family-places")
    heavy = sent.groupBy("kmer").count().where(F.col("count") > HEAVY).select("kmer", F.ceil(F.col("count") / HEAVY).cast("int").alias("salts"))
    heavy = F.broadcast(heavy)  # a row for each HEAVY rows of `sent` at most
    salts = F.coalesce("salts", F.lit(1))
    dealt = sent.join(heavy, "kmer", "left").select("ident", "kmer", "places", F.pmod(F.xxhash64("ident"), salts).cast("int").alias("salt"))
    copies = index.join(heavy, "kmer", "left").select("member", "kmer", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return dealt.join(copies, ["kmer", "salt"]).select("member", "ident", "places")


# ---- short sequences in the texts of their own group -----------------------------------------------------------------

#: A sequence that one packed k-mer is.
SHORT = "^[A-Z]{1,12}$"


def held_by_group(queries: DataFrame, refs: DataFrame, group: str, sequence: str = "seq", text: str = "text", held: int = HELD) -> DataFrame:
    """The distinct (sequence, group) of queries that a text of the same group holds; for sequences of SHORT.

    Numbers of k-mers of different lengths differ, so a sequence is one number. Up to `held` queries, every task holds them and
    sends each that it finds once; beyond, the texts' k-mers that pass a bit filter meet the queries by group and number. No
    text is shuffled, and a group with very many texts is read where they lie.
    """
    q = store(queries.select(sequence, group).where(F.col(sequence).rlike(SHORT) & F.col(group).isNotNull()).distinct(), "own-queries")
    lengths = sorted(r[0] for r in q.select(F.length(sequence)).distinct().collect())  # 12 at most
    n = q.count()
    t = refs.select(F.col(group).alias("group"), F.col(text).alias("text")).where("group is not null and text is not null")
    kind = dict(t.dtypes)["group"]
    if n <= held:
        rows = q.toArrow()
        coded = rows.column(group).combine_chunks().dictionary_encode()
        names, own = coded.dictionary, coded.indices.to_numpy()
        many, tables = max(1, len(names)), []
        whole = rows.column(sequence).combine_chunks()
        size = np.array([len(x) for x in whole.to_pylist()], np.int64)
        for k in lengths:
            at = np.flatnonzero(size == k)
            v = np.concatenate([x for _, x, _ in windows(whole.take(pa.array(at)), [k])])
            known, code = np.unique(v, return_inverse=True)
            pair = code * many + own[at]
            order = np.argsort(pair)
            tables.append((known, Near(known), pair[order], at[order]))
        shared = q.sparkSession.sparkContext.broadcast((tables, names, whole, own))

        def look_up(batches):
            tables, names, whole, own = shared.value
            seen = np.zeros(len(whole), bool)
            for b in batches:
                of = b.column("group").cast(names.type)
                of = pc.fill_null(pc.index_in(of, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                found = []
                for k, v, row in windows(b.column("text"), lengths):
                    known, near, pairs, at = tables[lengths.index(k)]
                    on = near.has(v)
                    v, row = v[on], row[on]
                    i = np.minimum(np.searchsorted(known, v), len(known) - 1)
                    hit = (known[i] == v) & (of[row] >= 0)
                    pair = np.unique(i[hit] * many + of[row[hit]])
                    j = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                    found.append(at[j[pairs[j] == pair]])
                new = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                new = new[~seen[new]]
                seen[new] = True
                if len(new):
                    yield pa.RecordBatch.from_arrays([whole.take(pa.array(new)), names.take(pa.array(own[new]))], [sequence, group])

        return t.mapInArrow(look_up, f"{sequence} string, {group} {kind}").distinct() if tables else q

    def number(batches):
        for b in batches:
            for k in lengths:
                at = np.flatnonzero(np.array([len(x) == k for x in b.column("seq").to_pylist()], bool))
                own = b.take(pa.array(at))
                for _, v, row in windows(own.column("seq"), [k]):
                    part = own.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([part.column("seq"), part.column("group"), pa.array(v)], ["seq", "group", "kmer"])

    index = store(q.select(F.col(sequence).alias("seq"), F.col(group).alias("group")).mapInArrow(number, f"seq string, group {kind}, kmer long"), "own-index")
    known = Bits(index, n)

    def passing(batches):
        for b in batches:
            for _, v, row in windows(b.column("text"), lengths):
                on = known.passes(v)
                r, v, _ = _counted(row[on], v[on])
                yield pa.RecordBatch.from_arrays([b.column("group").take(pa.array(r)), pa.array(v)], ["group", "kmer"])

    there = t.mapInArrow(passing, f"group {kind}, kmer long").distinct()
    return index.join(there, ["group", "kmer"], "left_semi").select(F.col("seq").alias(sequence), F.col("group").alias(group))


#: Parts that the nodes of a k-mer are dealt to before their smallest ones meet.
SALTS = 16


def star_edges(df: DataFrame, node: str, text: str, k: int) -> DataFrame:
    """(a, b): edges with the same components as if all nodes that share a k-mer were linked: each node to the smallest of its part of
    the k-mer's nodes, and those to the smallest of all. As many as nodes and k-mers, not their pairs."""
    w = _index(df, k, node, text).withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)))
    part = w.groupBy("kmer", "salt").agg(F.min("member").alias("low"))
    own = w.join(part, ["kmer", "salt"]).where("member <> low").select(F.col("low").alias("a"), F.col("member").alias("b"))
    least = part.groupBy("kmer").agg(F.min("low").alias("least"))
    top = part.join(least, "kmer").where("low <> least").select(F.col("least").alias("a"), F.col("low").alias("b"))
    return own.unionAll(top).distinct()
