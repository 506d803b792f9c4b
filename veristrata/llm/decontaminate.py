"""Operator 2, benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into pieces of at most PIECE words. Document frequencies are counted over all documents; every word
weighs, common or not. A latent space comes from a distributed randomised SVD of TF-IDF passages: all of the corpus's
own, copies as often as they are there, and all pieces. Every document is read in overlapping windows of WINDOW
words. A window whose cosine with a piece in the latent space reaches COSINE is checked by the longest common subsequence of
their words: NEAR of the piece in order is a leak; from PARAPHRASE on it is one if the item's answer (its last sentence) is
in the window as well. Pieces under SHORT words must be there word for word.

Cosines are worked out only for pairs that could pass the check: PARAPHRASE of a piece's words in order is at least as many
in any order, so a leak shares some of the piece's rarer words, of which an index has the pieces. Pairs that share enough
for NEAR are checked whatever their cosine, so no near copy within a window is lost.

Words of documents and items are made alike: white space of any script separates them, they are lower-cased (both small sigmas
are one) and bare of punctuation, and in scripts without blanks (Han, kana, Thai, Lao, Khmer, Burmese) each character is a
word. The benchmark is taken in blocks of BLOCK_BYTES of text, each with a
latent space of its own; TOGETHER blocks share two scans of the corpus, so what an executor holds is bounded. Null and empty texts and items match nothing; rows with equal ids, or without one, give equal rows
once.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import Words, discard, slices, squeeze, store, stretch, table, text_buffers

PIECE, STEP, WINDOW = 48, 24, 72
RANK, COSINE, NEAR, PARAPHRASE, ANSWER, SHORT = 128, 0.35, 0.75, 0.5, 0.8, 8
#: Words of a piece's indexed ones that a leak must have at least: the more, the more of the commoner words are indexed.
SHARED = 5
#: Passages of the corpus that are weighed and multiplied together; words of more than this share of them are multiplied as a dense matrix.
PASSAGES, DENSE = 2048, 0.04
#: Text of the items of a block, and blocks that one scan of the corpus serves.
BLOCK_BYTES, TOGETHER = 4 << 20, 8
#: Rows of the vocabulary that are added up together.
SLICE = 4096
#: Pairs of window and piece that are looked at together.
PAIRS = 4096


# Fixed values of Unicode: by their UTF-8 bytes, white space outside ASCII, and punctuation of scripts without blanks; then the
# ranges of first two bytes of characters that are words of their own; then what is trimmed off words.
_BLANK2 = {0xC2: {0x85, 0xA0}}
_BLANK3 = {(0xE1, 0x9A): {0x80}, (0xE2, 0x80): {*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF}, (0xE2, 0x81): {0x9F}, (0xE3, 0x80): {*range(0x80, 0x85), *range(0x88, 0xA1), 0xB0, 0xBD}, (0xEF, 0xBC): {*range(0x81, 0x90), *range(0x9A, 0xA1), *range(0xBB, 0xC0)}, (0xEF, 0xBD): {0x80, *range(0x9B, 0xA6)}}
_ALONE = [(0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE383), (0xE387, 0xE387), (0xE390, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBD, 0xEFBE), (0xF0A0, 0xF0B2)]
PUNCTUATION = string.punctuation + "«»‹›“”„‟‘’‚‛…–—―·¿¡§¶†‡•"

_ROOM = np.zeros(1 << 16, bool)
for _lo, _hi in _ALONE:
    _ROOM[_lo : _hi + 1] = True


def separated(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The bytes with white space of any script as blanks, and where words begin besides: at and after each character that is a word."""
    if not len(data) or data.max() < 0x80:
        return data, None
    data = np.append(data, np.zeros(4, np.uint8))  # room to look ahead
    two = np.flatnonzero(data == 0xC2)
    two = two[np.isin(data[two + 1], list(_BLANK2[0xC2]))]
    data[two], data[two + 1] = 32, 32
    three = np.flatnonzero(data >= 0xE0)
    head = (data[three].astype(np.int64) << 8) | data[three + 1]
    for (a, b), last in _BLANK3.items():
        at = three[head == (a << 8 | b)]
        at = at[np.isin(data[at + 2], list(last))]
        data[at], data[at + 1], data[at + 2] = 32, 32, 32
    alone = three[_ROOM[head] & (data[three] != 32)]
    after = alone + np.where(data[alone] >= 0xF0, 4, 3)
    data = data[:-4]
    cut = np.append(alone, after[after < len(data)])
    return data, cut if len(cut) else None


def folded(words: pa.Array) -> pa.Array:
    """Lower case, bare of punctuation."""
    low = pc.replace_substring(pc.utf8_lower(words), "ς", "σ")
    return pc.utf8_trim(low, characters=PUNCTUATION)


class Tokens:
    """Words of some texts as numbers into a vocabulary: `ids` (-1 for others), `off` words before each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, vocab: pa.Array):
        data, cut = separated(data)
        w = Words(data, offs, cut=cut)
        bare = folded(w.vocab) if len(w.vocab) else w.vocab
        known = pc.fill_null(pc.index_in(bare, value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(bare) else np.zeros(0, np.int64)
        some = (pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0) if len(bare) else np.zeros(0, bool)
        keep = some[w.codes] if len(w.codes) else np.zeros(0, bool)
        self.ids = known[w.codes][keep] if len(w.codes) else known
        self.off = np.append(0, np.cumsum(keep))[w.off]


def item_words(text: str | None) -> list[str]:
    """The words of a text, as Tokens makes them."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    data, cut = separated(raw)
    w = Words(data, np.array([0, len(data)]), cut=cut)
    if not len(w.codes):
        return []
    bare = folded(w.vocab).to_pylist()
    return [x for x in (bare[c] for c in w.codes.tolist()) if x]


def answer_of(text: str | None) -> list[str]:
    """The words of the last sentence that has any."""
    for part in reversed(re.split(r"[.!?\n。！？]+", text or "")):
        if words := item_words(part):
            return words
    return []


def lcs(masks: dict[int, int], m: int, ids: list[int]) -> int:
    """Longest common subsequence of a sequence of m ids, given as bit masks of their places, with ids."""
    v = full = (1 << m) - 1
    for x in ids:
        if (s := masks.get(x)) is not None:
            u = v & s
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def masks_of(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(ids):
        out[x] = out.get(x, 0) | 1 << k
    return out


def postings(pieces: list, light: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first posting of each word, pieces by word, indexed words that a leak of each piece has, and that a near copy has).

    A leak has PARAPHRASE of a piece's words in order, so as many in any order. The commonest words are in no posting, as long
    as SHARED of those needed are left whatever a window has of them.
    """
    word, piece, need, near = [], [], np.full(len(pieces), 1 << 30, np.int64), np.full(len(pieces), 1 << 30, np.int64)
    for k in np.flatnonzero(~light).tolist():
        at, n = np.unique(pieces[k][1], return_counts=True)
        total = int(n.sum())
        order = np.argsort(-df[at], kind="stable")
        least = math.ceil(PARAPHRASE * total)
        spared = np.cumsum(n[order]) <= least - min(SHARED, least)
        out = int(n[order][spared].sum())
        need[k], near[k] = least - out, math.ceil(NEAR * total) - out
        word.append(at[order][~spared])
        piece.append(np.full(len(word[-1]), k))
    words = np.concatenate(word) if word else np.zeros(0, np.int64)
    by = np.argsort(words, kind="stable")
    return np.searchsorted(words[by], np.arange(len(df) + 1)), np.concatenate(piece)[by] if word else words, need, near


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how often each is there, or the sum of its n)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n, first) if len(first) else n


def shared_words(first: np.ndarray, owners: np.ndarray, need: np.ndarray, tok: np.ndarray, where: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, piece, indexed words in common) of all pairs that have `need` of them. tok: words in order; where: the chunk of each; the
    windows that have chunk c start at chunks low[c] to high[c]."""
    n = first[tok + 1] - first[tok]
    tok, where, n = tok[n > 0], where[n > 0], n[n > 0]
    many = max(1, len(need))
    pair, times = counted(np.repeat(where, n) * many + owners[np.arange(n.sum()) + np.repeat(first[tok] - (np.cumsum(n) - n), n)])
    chunk, piece = pair // many, pair % many
    keys, sums = [], []
    for back in range(WINDOW // STEP):
        start = chunk - back
        on = (start >= low[chunk]) & (start <= high[chunk])
        keys.append(start[on] * many + piece[on])
        sums.append(times[on])
    key, total = counted(np.concatenate(keys), np.concatenate(sums))
    on = total >= need[key % many]
    return key[on] // many, key[on] % many, total[on]


def survey(docs: DataFrame, vocab: list[str]) -> tuple[np.ndarray, int, DataFrame]:
    """(documents that have each word, documents, stored passages (at, tf)), over whole texts. Passages are windows by the words of
    the vocabulary in them: every one of the corpus that has any, PASSAGES a row, each as its length, its words and how often they are there."""
    words = pa.array(vocab, pa.string())
    n = len(vocab)
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32())]

    def count(batches):
        from pyspark import TaskContext

        acc = np.zeros(n + 1, np.int64)
        for b in slices(batches):
            t = Tokens(*text_buffers(b.column("text")), words)
            doc = np.repeat(np.arange(b.num_rows), np.diff(t.off))
            on = t.ids >= 0
            acc[:n] += np.bincount(counted(doc[on] * n + t.ids[on])[0] % n, minlength=n)
            acc[n] += b.num_rows
            place = (np.arange(len(doc)) - t.off[doc]) // WINDOW
            of = np.cumsum(np.diff(doc * (1 << 32) + place, prepend=-1) != 0)
            pair, tf = counted(of[on] * n + t.ids[on])
            first = np.flatnonzero(np.diff(pair // n, prepend=-1))
            sizes = np.diff(np.append(first, len(pair)))
            for k in range(0, len(first), PASSAGES):
                size = sizes[k : k + PASSAGES]
                own = slice(first[k], first[k] + size.sum())
                row = [None, None, size.astype(np.int32), (pair[own] % n).astype(np.int32), tf[own].astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], ["k", "n", "size", "at", "tf"])
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip([part, squeeze(acc), None, None, None], kinds, strict=True)], ["k", "n", "size", "at", "tf"])

    def add(batches):
        acc = np.zeros(n + 1, np.int64)
        for b in batches:
            for x in b.column("n").to_pylist():
                acc += stretch(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(acc)], pa.binary())], ["n"])

    found = store(docs.mapInArrow(count, "k int, n binary, size array<int>, at array<int>, tf array<float>"), "leak-survey")
    total = np.zeros(n + 1, np.int64)
    for r in found.where("k is not null").select("k", "n").repartition(8, "k").select("n").mapInArrow(add, "n binary").collect():  # 8 rows at most
        total += stretch(r.n, np.int64)
    passages = found.where("k is null").select("size", "at", "tf")
    return total[:n], int(total[n]), passages


def layered(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(n groups, largest first; entries by their place in their group, then by group in that order; entries of each place)."""
    count = np.bincount(group, minlength=n)
    order = np.argsort(-count, kind="stable")
    rank, small = np.empty(n, np.int64), np.uint16 if max(n, len(group)) < 1 << 16 else np.int64  # short keys are sorted by digits
    rank[order] = np.arange(n)
    entries = np.argsort(rank[group].astype(small), kind="stable")
    count = count[order]
    place = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
    return order, entries[np.argsort(place.astype(small), kind="stable")], np.bincount(place).tolist()


def gathered(group: np.ndarray, n: int, of: np.ndarray, x: np.ndarray | None, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n groups in some order, for each the sum of rows[of], times x if given, over its entries): the groups' k-th entries are added at once."""
    order, entries, sizes = layered(group, n)
    out, at = np.zeros((n, rows.shape[1]), np.float32), 0
    for m in sizes:
        own = entries[at : at + m]
        part = rows[of[own]]
        if x is not None:
            part *= x[own, None]
        out[:m] += part
        at += m
    return order, out


def add_product(z: np.ndarray, v: np.ndarray, size: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
    """z += A'(A v) for a sparse A of len(size) rows: common words as a dense matrix, others entry by entry."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    count = np.bincount(at, minlength=len(v))
    common = count > DENSE * n
    often, rare = np.flatnonzero(common), np.flatnonzero((count > 0) & ~common)
    number = np.zeros(len(v), np.int64)
    number[often], number[rare] = np.arange(len(often)), np.arange(len(rare))
    on, col = common[at], number[at]
    a = np.zeros((n, len(often)), np.float32)
    a[row[on], col[on]] = w[on]
    row, col, at, w = row[~on], col[~on], at[~on], w[~on]
    y = a @ v[often]
    if len(at):
        own, part = gathered(row, n, at, w, v)
        y[own] += part
    z[often] += a.T @ y
    if len(at):
        own, part = gathered(col, len(rare), row, w, y)
        z[rare[own]] += part


def randomised_svd(rows: DataFrame, dims: int, rank: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(dims x rank right singular vectors, singular values) of sparse rows, some together, as packed numbers (size: int32, of each; at: int32; w: float32).

    Subspace iteration from a random start: each round sums A'(A V) over the partitions of the rows.
    """
    sc = rows.sparkSession.sparkContext
    v = np.linalg.qr(np.random.default_rng(7).standard_normal((dims, rank)))[0].astype(np.float32)
    z = v
    for _ in range(rounds + 1):
        shared = sc.broadcast(v)

        def product(batches, shared=shared):
            v, z = shared.value, np.zeros((dims, rank), np.float64)
            for b in batches:
                for size, at, w in zip(*(b.column(c).to_pylist() for c in ("size", "at", "w")), strict=True):
                    add_product(z, v, stretch(size, np.int32), stretch(at, np.int32), stretch(w, np.float32))
            for k in range(0, dims, SLICE):
                own = z[k : k + SLICE]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeeze(own.astype(np.float32))], pa.binary())], ["k", "z"])

        def add(batches):
            sums = {}
            for b in batches:
                for k, x in zip(b.column("k").to_pylist(), b.column("z").to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + stretch(x, np.float32).astype(np.float64)
            for k, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeeze(x.astype(np.float32))], pa.binary())], ["k", "z"])

        z = np.zeros((dims, rank))  # one matrix: the sums of its slices are made by tasks
        for r in rows.select("size", "at", "w").mapInArrow(product, "k int, z binary").repartition(min(64, -(-dims // SLICE)), "k").mapInArrow(add, "k int, z binary").collect():
            z[r.k : r.k + SLICE] = stretch(r.z, np.float32).reshape(-1, rank)
        shared.destroy()
        last, v = v, np.linalg.qr(z)[0].astype(np.float32)
    values, turn = np.linalg.eigh(last.astype(np.float64).T @ z)
    order = np.argsort(-values)
    return (last @ turn[:, order]).astype(np.float32), np.sqrt(np.maximum(values[order], 0))


def find_leaks(docs: DataFrame, items: DataFrame, rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, at_word, answer_found): a row for each document and item that it leaks."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    found = None
    for k in range(0, blocks, TOGETHER):
        of = F.pmod(F.xxhash64("text"), F.lit(blocks))
        rows = bench.where((of >= k) & (of < k + TOGETHER)).select("item_id", "text", of.alias("block")).collect()  # TOGETHER * BLOCK_BYTES of text, about
        own = [[(r.item_id, r.text) for r in rows if r.block == j] for j in range(k, min(k + TOGETHER, blocks))]
        part = _search(spark, texts, [x for x in own if x], rank, cosine)
        found = part if found is None else found.unionAll(part)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "cosine", -F.col("at_word"), "answer_found")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.cosine").alias("cosine"), F.col("b.lcs").alias("lcs"), (-F.col("b.col3")).alias("at_word"), F.col("b.answer_found").alias("answer_found"))


class Block:
    """Some items: their words as numbers into an own vocabulary, and their pieces (item, ids, masks, answer)."""

    def __init__(self, own: list[tuple[int, str]]):
        words = [item_words(t) for _, t in own]
        self.vocab = sorted({x for w in words for x in w})
        number = {x: i for i, x in enumerate(self.vocab)}
        self.pieces = []
        for (item, text), w in zip(own, words, strict=True):
            n = max(1, math.ceil(len(w) / PIECE))
            for j in range(n if w else 0):
                ids = [number[x] for x in w[len(w) * j // n : len(w) * (j + 1) // n]]
                self.pieces.append((item, ids, masks_of(ids), [number[x] for x in answer_of(text)]))

    def space(self, spark, passages: DataFrame, to_own: np.ndarray, df: np.ndarray, n_docs: int, rank: int) -> tuple:
        """What a search needs: word vectors, latent pieces, the pieces, which are short, their postings, own numbers of words."""
        idf = (np.log((1 + n_docs) / (1 + df)) + 1e-3).astype(np.float32)
        rows = []
        for _, ids, _, _ in self.pieces:
            at, tf = np.unique(ids, return_counts=True)
            rows.append((at.tolist(), tf.astype(float).tolist()))
        shared = spark.sparkContext.broadcast((idf, to_own))

        def weigh(batches):
            idf, to_own = shared.value
            for b in batches:
                sizes, places, weights = [], [], []
                for size, at, tf, share, common in zip(*(b.column(c) for c in ("size", "at", "tf")), b.column("share").to_pylist(), b.column("common").to_pylist(), strict=True):
                    size, at, tf = (c.values.to_numpy() for c in (size, at, tf))
                    row = np.repeat(np.arange(len(size)), size)
                    if common:  # numbers of the vocabulary of all blocks
                        at = to_own[at]
                        row, at, tf = row[at >= 0], at[at >= 0], tf[at >= 0]
                    x = tf * idf[at]
                    norm = np.sqrt(np.bincount(row, x.astype(np.float64) ** 2, len(size)))
                    sizes.append(squeeze(np.bincount(row, minlength=len(size)).astype(np.int32)))
                    places.append(squeeze(at.astype(np.int32)))
                    weights.append(squeeze((x * (share / np.maximum(1e-9, norm))[row]).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (sizes, places, weights)], ["size", "at", "w"])

        share = math.sqrt(max(1, passages.agg(F.sum(F.size("size"))).first()[0] or 0) / len(rows))  # the pieces weigh as much as the corpus's passages
        own = spark.createDataFrame(rows, "at array<int>, tf array<float>").select(F.array(F.size("at")).alias("size"), "at", "tf", F.lit(share).alias("share"), F.lit(False).alias("common"))
        both = own.unionAll(passages.select("size", "at", "tf", F.lit(1.0), F.lit(True)))
        matrix = store(both.mapInArrow(weigh, "size binary, at binary, w binary"), "leak-matrix")
        space, _ = randomised_svd(matrix, len(self.vocab), min(rank, len(self.pieces), len(self.vocab)))
        discard(matrix)
        latent = np.stack([(np.asarray(tf, np.float32) * idf[at]) @ space[at] for at, tf in rows])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        table_ = (space * idf[:, None]).astype(np.float32)
        light = np.array([len(p[1]) < SHORT for p in self.pieces])
        return table_, latent, self.pieces, light, postings(self.pieces, light, df), to_own


def _search(spark, texts: DataFrame, owns: list[list[tuple[int, str]]], rank: int, least: float) -> DataFrame:
    """All blocks of items in two scans of the texts: one that counts their words, one that looks for them."""
    schema = "doc_id long, item_id long, cosine double, lcs double, at_word long, answer_found boolean"
    blocks = [x for x in map(Block, owns) if x.vocab]
    vocab = sorted({x for block in blocks for x in block.vocab})
    if not vocab:
        return spark.createDataFrame([], schema)
    df, n_docs, passages = survey(texts.select("text"), vocab)
    number, shared = {x: i for i, x in enumerate(vocab)}, []
    for block in blocks:
        at = np.array([number[x] for x in block.vocab])
        to_own = np.full(len(vocab) + 1, -1, np.int64)  # the last place is that of other words
        to_own[at] = np.arange(len(at))
        shared.append(spark.sparkContext.broadcast(block.space(spark, passages, to_own, df[at], n_docs, rank)))
    lookup = pa.array(vocab, pa.string())
    span = WINDOW // STEP

    def run(batches):
        blocks = []
        for x in shared:
            table_, latent, pieces, light, posted, to_own = x.value
            tails: dict[int, list[int]] = {}
            for k in np.flatnonzero(light).tolist():
                tails.setdefault(pieces[k][1][-1], []).append(k)
            blocks.append((table_, latent, pieces, [masks_of(p[3]) for p in pieces], posted, to_own, tails))
        for b in slices(batches):
            t = Tokens(*text_buffers(b.column("text")), lookup)
            doc_ids = b.column("doc_id")
            n = np.diff(t.off)
            chunks = -(-n // STEP)
            doc = np.repeat(np.arange(len(n)), chunks)
            first_chunk = np.cumsum(chunks) - chunks
            begin = t.off[doc] + (np.arange(len(doc)) - first_chunk[doc]) * STEP
            low, high = first_chunk[doc], first_chunk[doc] + np.maximum(chunks[doc] - span, 0)
            hits = []
            for table_, latent, pieces, answers, (first, owners, need, near), to_own, tails in blocks:
                own = to_own[t.ids]
                on = np.flatnonzero(own >= 0)
                where = np.searchsorted(begin, on, "right") - 1
                known = own[on]
                window, piece, common = shared_words(first, owners, need, known, where, low, high)
                for lo in range(0, len(window), PAIRS):
                    w, p, c = (x[lo : lo + PAIRS] for x in (window, piece, common))
                    starts, of = np.unique(w, return_inverse=True)
                    stops = np.minimum(starts + span, (first_chunk + chunks)[doc[starts]])
                    cover = starts[:, None] + np.arange(span)
                    inside = cover < stops[:, None]
                    needed = np.unique(cover[inside])  # chunks, which windows that overlap share
                    i, j = np.searchsorted(where, needed), np.searchsorted(where, needed, "right")
                    words_ = known[np.arange((j - i).sum()) + np.repeat(i - (np.cumsum(j - i) - (j - i)), j - i)]
                    order, part = gathered(np.repeat(np.arange(len(needed)), j - i), len(needed), words_, None, table_)
                    vectors = np.zeros((len(needed) + 1, table_.shape[1]), np.float32)
                    vectors[order] = part
                    q = vectors[np.where(inside, np.searchsorted(needed, cover), len(needed))].sum(1)
                    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
                    cos = np.einsum("ij,ij->i", q[of], latent[p])
                    for k in np.flatnonzero((cos >= least) | (c >= near[p])).tolist():
                        d = int(doc[w[k]])
                        a, z = int(begin[w[k]]), int(min(t.off[d + 1], begin[w[k]] + WINDOW))
                        ids = own[a:z].tolist()
                        item, own_ids, masks, answer = pieces[p[k]]
                        share = lcs(masks, len(own_ids), ids) / len(own_ids)
                        if share >= PARAPHRASE:
                            told = bool(answer) and lcs(answers[p[k]], len(answer), ids) >= ANSWER * len(answer)
                            if share >= NEAR or (told and cos[k] >= least):
                                hits.append((d, item, float(cos[k]), share, a - int(t.off[d]), told))
                if tails:  # short pieces: their last word, then all of them
                    for e in np.flatnonzero(np.isin(own, list(tails))).tolist():
                        d = int(np.searchsorted(t.off, e, "right") - 1)
                        for p in tails[int(own[e])]:
                            m = len(pieces[p][1])
                            if e - m + 1 >= t.off[d] and own[e - m + 1 : e + 1].tolist() == pieces[p][1]:
                                hits.append((d, pieces[p][0], 1.0, 1.0, e - m + 1 - int(t.off[d]), True))
            if hits:
                d, item, cos_, share, at, told = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(d)), pa.array(item, pa.int64()), pa.array(cos_), pa.array(share), pa.array(at, pa.int64()), pa.array(told)], ["doc_id", "item_id", "cosine", "lcs", "at_word", "answer_found"])

    return texts.mapInArrow(run, schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
