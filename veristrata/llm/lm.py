"""Operator 1, LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Classes: the end of a text, the HEADS commonest words (one
each), and buckets of the last two letters of all other words. Both factors are maximum-entropy models:

1. P(class | history): features of the class before (n-gram), the class before that alone (skip), both (n-gram), the word before
   (n-gram), and the word before with the class before that (n-gram). The features of classes are trained first, by
   distributed gradient updates over all contexts of the training texts with their counts; those of words lie in buckets by
   word, each of which trains its own, with the class features as a fixed start.
2. P(word | class, history): a softmax over the LISTED commonest words of the class and one outcome for all its rarer words, with a
   feature for each pair of the word before and the outcome, hashed into the cells of the bucket of the word before, on
   top of the outcome's share of the class. Each bucket trains its cells by gradient updates over all its pairs.

A rarer word's own share of its outcome is (count + 1) / (tokens + types + 1) among the rarer words of its class; one of the types
stands for unknown words. Their counts live in buckets by word and grow with the corpus, as do the pairs and contexts that
are gathered; packed rows send each rarer word once, as it is, with its count, and get its count in all texts back.

Texts are scored a packed row at a time: its distinct contexts get one softmax each. A null text is empty (its end is its one
token). A null id is taken for training. Rows with equal ids are scored each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import NO_ID, Words, discard, id_array, mix, pack, squeeze, store, stretch, table, text_buffers, tidy, unpack

HEADS, CLASSES, ROWS = 31, 128, 1 << 14
#: Commonest words that are outcomes and histories of their own, and those of them that are histories of classes.
LISTED, CONTEXTS = 8192, 1024
#: Buckets of histories: of classes and of words; hashed rows of a bucket of contexts, hashed cells of a bucket of pairs.
CONTEXT_PARTS, PAIR_PARTS, CONTEXT_ROWS, PAIR_CELLS = 32, 64, 512, 1 << 16
ROUNDS, RATE, DAMP, OWN_ROUNDS = 8, 0.45, 4.0, 6
#: Pull of the weights of histories and of pairs towards nought, in observations, and what steadies the steps of pairs.
HISTORY_PULL, PAIR_PULL, PAIR_DAMP = 0.1, 0.5, 1.0
#: Slices of the weights when gradients are added.
SLICES = 8
BUCKET_BYTES, LEAST = 8 << 20, 24
#: Gathered cells that a task holds before it adds them up.
PENDING = 1 << 20

U = np.uint64


def held_out(ids: np.ndarray, modulus: int = 7, remainder: int = 2) -> np.ndarray:
    return np.fromiter((i != NO_ID and zlib.crc32(str(i).encode()) % modulus == remainder for i in ids.tolist()), bool, len(ids))


def bucket_of_ending(vocab: pa.Array) -> np.ndarray:
    """Class of each word by its last two bytes; one mark of punctuation at the end doesn't count."""
    data, offs = text_buffers(vocab)
    data = np.append(np.zeros(3, np.uint8), data).astype(np.int64)
    n, last = np.diff(offs), offs[1:] + 2
    c = data[last]
    mark = (c < 128) & ~(((c >= 97) & (c <= 122)) | ((c >= 48) & (c <= 57))) & (n > 1)
    last, n = last - mark, n - mark
    pair = data[last] * 256 + np.where(n > 1, data[last - 1], 0)
    return 1 + HEADS + (mix(pair.astype(U) + U(77)) % U(CLASSES - 1 - HEADS)).astype(np.int64)


def classes_of(listed: list[str]) -> np.ndarray:
    """The class of each listed word, commonest first."""
    n = len(listed)
    return np.where(np.arange(n) < HEADS, 1 + np.arange(n), bucket_of_ending(pa.array(listed, pa.string())) if n else 0).astype(np.int64)


class Row:
    """A packed row of texts, tokenised. For each token, ends included: its class, the two classes before it, and `out`, its number among
    the outcomes: a listed word, or len(listed) + class for rarer words and the end. `last` is the out of the token before."""

    def __init__(self, ids: bytes, lens: bytes, body: bytes, listed: pa.Array):
        self.ids, data, offs = unpack(ids, lens, body)
        self.train = ~held_out(self.ids)
        self.w = w = Words(data, offs, lower=True)
        some = len(w.vocab) > 0
        self.listed = pc.fill_null(pc.index_in(w.vocab, value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64) if some else np.zeros(0, np.int64)
        self.classes = np.where((self.listed >= 0) & (self.listed < HEADS), 1 + self.listed, bucket_of_ending(w.vocab)) if some else self.listed
        n = np.diff(w.off)
        self.n_tokens = n + 1
        self.doc = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(w.codes)) + self.doc  # place of each word among the tokens
        self.first = np.append(0, np.cumsum(self.n_tokens))
        size = int(self.first[-1])
        self.x, self.out = np.zeros(size, np.int64), np.full(size, len(listed), np.int64)
        if len(w.codes):
            self.x[self.at] = self.classes[w.codes]
            self.out[self.at] = np.where(self.listed >= 0, self.listed, len(listed) + self.classes)[w.codes]
        self.one, self.two, self.last = np.zeros_like(self.x), np.zeros_like(self.x), np.full_like(self.x, len(listed))
        self.one[1:], self.two[2:], self.last[1:] = self.x[:-1], self.x[:-2], self.out[:-1]
        begin = self.first[:-1] + 1
        self.two[self.first[:-1]] = 0
        self.two[begin[begin < size]] = 0
        self.last[self.first[:-1]] = len(listed)

    def rare(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(rarer words of the vocabulary by bucket, cuts): the same order each time."""
        own = np.flatnonzero(self.listed < 0)
        if not len(own):
            return own, np.zeros(n_buckets + 1, np.int64)
        part = (mix(self.w.hashes()[own]) % U(n_buckets)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        return own[by], np.searchsorted(part[by], np.arange(n_buckets + 1))


@dataclass
class Shape:
    """Sizes that follow the number of listed words: histories of classes, outcomes, and how many of each a bucket has."""

    listed: int
    classes: np.ndarray  # of listed words

    def __post_init__(self):
        self.common = min(CONTEXTS, self.listed)
        self.histories = self.common + CLASSES
        self.outcomes = self.listed + CLASSES
        self.history_width = -(-self.histories // CONTEXT_PARTS)
        self.pair_width = -(-self.outcomes // PAIR_PARTS)
        self.class_of_outcome = np.append(self.classes, np.arange(CLASSES))
        self.class_of_history = np.append(self.classes[: self.common], np.arange(CLASSES))
        own = np.arange(self.outcomes)
        self.history_of = np.where(own < self.common, own, self.common + self.class_of_outcome)
        self.by_class = np.argsort(self.class_of_outcome, kind="stable")
        self.class_cuts = np.searchsorted(self.class_of_outcome[self.by_class], np.arange(CLASSES))


def rows_of(context: np.ndarray) -> list[np.ndarray]:
    """Rows of the weights for the three class features of each context (class before that * CLASSES + class before); row 0 is the bias."""
    one, two = (context % CLASSES).astype(U), (context // CLASSES).astype(U)
    place = lambda kind, v: 1 + (mix(v * U(4) + U(kind)) % U(ROWS - 1)).astype(np.int64)
    return [place(1, one), place(2, two), place(3, context.astype(U))]


def logits(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    z = np.broadcast_to(weights[0], (len(context), CLASSES)).copy()
    for r in rows_of(context):
        z += weights[r]
    return z


def normalised(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def log_softmax(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    return normalised(logits(weights, context))


def own_rows(history: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Row, within a bucket's hashed rows, of a history with the class before it."""
    return (mix(history.astype(U) * U(CLASSES) + two.astype(U) + U(0x51ED)) % U(CONTEXT_ROWS)).astype(np.int64)


def pair_cells(last: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Cell, within a bucket's hashed cells, of a pair of the word before and an outcome."""
    return (mix(last.astype(U) * U(0x1F0F3) + out.astype(U) + U(0xA5A5)) % U(PAIR_CELLS)).astype(np.int64)


def common_words(packed: DataFrame) -> list[str]:
    """The commonest words of all training texts, by exact counts over the whole corpus (ties in the order of the words), LISTED at most.
    Which they are does not depend on how texts are packed or dealt out."""

    def run(batches):
        none = pa.array([], pa.string())
        for b in batches:
            for ids, lens, body in zip(*(b.column(c).to_pylist() for c in ("ids", "lens", "body")), strict=True):
                r = Row(ids, lens, body, none)
                if not len(r.w.codes):
                    continue
                n = np.bincount(r.w.codes[r.train[r.doc]], minlength=len(r.w.vocab))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([r.w.vocab.take(pa.array(seen)), pa.array(n[seen], pa.int64())], ["word", "n"])

    found = packed.select("ids", "lens", "body").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in found.orderBy(F.desc("n"), "word").limit(LISTED).collect()]


class Cells:
    """Counts of numbered cells, as a task gathers them: sorted places and their counts."""

    def __init__(self):
        self.waiting, self.n = [], 0
        self.at, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, cells: np.ndarray) -> None:
        self.waiting.append(np.unique(cells, return_counts=True))
        self.n += len(self.waiting[-1][0])
        if self.n > PENDING:
            self.settle()

    def settle(self) -> None:
        at = np.concatenate([self.at, *(a for a, _ in self.waiting)])
        n = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        self.at, self.counts = at[first], np.add.reduceat(n, first) if len(first) else n
        self.waiting, self.n = [], 0

    def rows(self, kind: int, width: int):
        """(kind, bucket, steps between places, counts) for each bucket of `width` cells."""
        self.settle()
        part = self.at // width
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        for i, j in zip(cut, cut[1:], strict=False):
            p = int(part[i])
            yield kind, p, squeeze(np.diff(self.at[i:j], prepend=p * width).astype(np.uint32)), squeeze(self.counts[i:j])
        self.at, self.counts = self.at[:0], self.counts[:0]


def survey(packed: DataFrame, listed: list[str], shape: Shape, n_buckets: int) -> DataFrame:
    """What all packed rows say of contexts (kind 0), listed words (kind 1), rarer words (kind 2, by bucket) and pairs (kind 3)."""
    schema = "kind int, key int, src long, a binary, b binary"
    names = pa.array(listed, pa.string())

    def run(batches):
        counts = np.zeros(len(listed) + 1, np.int64)
        contexts, pairs = Cells(), Cells()
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "key", "src", "a", "b"])
        for b in batches:
            for src, ids, lens, body in zip(*(b.column(c).to_pylist() for c in ("src", "ids", "lens", "body")), strict=True):
                r = Row(ids, lens, body, names)
                on = np.repeat(r.train, r.n_tokens)
                if on.any():
                    contexts.add(((shape.history_of[r.last] * CLASSES + r.two) * CLASSES + r.x)[on])
                    pairs.add((r.last * shape.outcomes + r.out)[on])
                counts[-1] += int(r.train.sum())
                if not len(r.w.codes):
                    continue
                own = np.bincount(r.w.codes[r.train[r.doc]], minlength=len(r.w.vocab))
                here = r.listed >= 0
                counts[:-1] += np.bincount(r.listed[here], own[here], len(listed)).astype(np.int64)
                by, cut = r.rare(n_buckets)
                rows = []
                for p in np.flatnonzero(np.diff(cut)):
                    i = by[cut[p] : cut[p + 1]]
                    rows.append((2, int(p), src, squeeze(np.frombuffer("\n".join(r.w.vocab.take(pa.array(i)).to_pylist()).encode(), np.uint8)), squeeze(own[i].astype(np.int64))))
                if rows:
                    yield made(rows)
                tidy()
        rows = [(k, p, 0, a, c) for k, p, a, c in (*contexts.rows(0, shape.history_width * CLASSES**2), *pairs.rows(3, shape.pair_width * shape.outcomes))]
        yield made([*rows, (1, 0, 0, squeeze(counts), None)])

    return packed.select("src", "ids", "lens", "body").mapInArrow(run, schema)


def judge_words(words: DataFrame) -> DataFrame:
    """Exact counts by bucket: to each packed row the count of each word that it sent, in that order; and tokens and types by class
    (src -1)."""

    def run(key, t):
        raw = [stretch(x, np.uint8).tobytes().split(b"\n") for x in t.column("a").to_pylist()]
        n = np.array([len(x) for x in raw])
        coded = pa.array([w for x in raw for w in x], pa.binary()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        own = np.concatenate([stretch(x, np.int64) for x in t.column("b").to_pylist()])
        total = np.bincount(codes, own, len(coded.dictionary)).astype(np.int64)
        seen = np.flatnonzero(total)
        cls = bucket_of_ending(coded.dictionary.cast(pa.string()))[seen]
        types, tokens = np.bincount(cls, minlength=CLASSES), np.bincount(cls, total[seen], CLASSES).astype(np.int64)
        cut = np.append(0, np.cumsum(n))
        src = [*t.column("src").to_pylist(), -1]
        answers = [squeeze(total[codes[i:j]]) for i, j in zip(cut, cut[1:], strict=False)] + [squeeze(np.append(types, tokens))]
        tidy()
        return pa.table({"src": pa.array(src, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(src), pa.int32()), "counts": pa.array(answers, pa.binary())})

    return words.groupBy("key").applyInArrow(run, "src long, bucket int, counts binary")


def added_up(found: DataFrame, kind: int, parts: int, size: int) -> DataFrame:
    """(key, a: places, b: counts): the cells of one kind, added by bucket with one dense sum for each."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for key, a, c in zip(*(b.column(i).to_pylist() for i in ("key", "a", "b")), strict=True):
                acc = sums.setdefault(key, np.zeros(size, np.int64))
                acc[np.cumsum(stretch(a, np.uint32).astype(np.int64))] += stretch(c, np.int64)
        for key, acc in sums.items():
            on = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([squeeze(on)], pa.binary()), pa.array([squeeze(acc[on])], pa.binary())], ["key", "a", "b"])
        tidy()

    return found.where(F.col("kind") == kind).select("key", "a", "b").repartition(parts, "key").mapInArrow(run, "key int, a binary, b binary")


def class_contexts(contexts: DataFrame, shape: Shape) -> DataFrame:
    """(a, b): places (context * CLASSES + class) and counts of contexts of classes alone, a row for each bucket of histories."""

    def run(batches):
        for b in batches:
            for key, a, c in zip(*(b.column(i).to_pylist() for i in ("key", "a", "b")), strict=True):
                cell = stretch(a, np.int64) + key * shape.history_width * CLASSES**2
                history, two, x = cell // CLASSES**2, cell // CLASSES % CLASSES, cell % CLASSES
                at, back = np.unique((two * CLASSES + shape.class_of_history[history]) * CLASSES + x, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([squeeze(at)], pa.binary()), pa.array([squeeze(np.bincount(back, stretch(c, np.int64)))], pa.binary())], ["a", "b"])

    return contexts.mapInArrow(run, "a binary, b binary")


def train(contexts: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(weights of class features, training tokens of each class, log2 loss a token before each round) from stored (a: cells, b: counts).

    A round: every part of the contexts works out observed and expected counts of each feature and class; the sums come in
    SLICES slices of the weights; each weight moves by its gradient over its expected count, the diagonal of the curvature.
    The driver holds the weights, ROWS * CLASSES numbers.
    """
    spark = contexts.sparkSession

    def totals(batches):
        for b in batches:
            for a, c in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                n = np.bincount(stretch(a, np.int64) % CLASSES, stretch(c, np.float64), CLASSES)
                yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], ["n"])

    tokens = np.zeros(CLASSES)
    for r in contexts.select("a", "b").mapInArrow(totals, "n binary").collect():  # CONTEXT_PARTS rows
        tokens += np.frombuffer(r.n, np.float64)
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[0] = np.log((tokens + 0.5) / (tokens.sum() + 0.5 * CLASSES))
    rate, losses, width = RATE, [], ROWS // SLICES
    for _ in range(rounds if tokens.sum() else 0):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches, shared=shared):
            w = shared.value
            grad, seen, loss = np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, CLASSES), np.float32), 0.0
            for b in batches:
                for a, c in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                    cell, n = stretch(a, np.int64), stretch(c, np.float64)
                    for own, obs, _ in _blocks(cell, n):
                        logp = log_softmax(w, own)
                        loss -= float((obs * logp).sum(dtype=np.float64))
                        want = np.exp(logp) * obs.sum(1, keepdims=True)
                        obs -= want
                        for r in [np.zeros(len(own), np.int64), *rows_of(own)]:
                            _scatter(grad, r, obs)
                            _scatter(seen, r, want)
            for k in range(SLICES):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([loss if k == 0 else 0.0]), pa.array([squeeze(grad[k * width : (k + 1) * width])], pa.binary()), pa.array([squeeze(seen[k * width : (k + 1) * width])], pa.binary())], ["k", "loss", "grad", "seen"])

        def added(batches):
            sums: dict[int, list] = {}
            for b in batches:
                for k, loss, g, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    acc = sums.setdefault(k, [0.0, np.zeros(width * CLASSES), np.zeros(width * CLASSES)])
                    acc[0] += loss
                    acc[1] += stretch(g, np.float32)
                    acc[2] += stretch(s, np.float32)
            for k, (loss, g, s) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([loss]), pa.array([squeeze((g / (s + DAMP)).astype(np.float32))], pa.binary())], ["k", "loss", "step"])

        got = contexts.select("a", "b").mapInArrow(gradient, "k int, loss double, grad binary, seen binary").repartition(SLICES, "k").mapInArrow(added, "k int, loss double, step binary").collect()
        losses.append(sum(r.loss for r in got) / tokens.sum() / np.log(2))
        if len(losses) > 1 and losses[-1] > losses[-2]:
            rate /= 2
        for r in got:
            weights[r.k * width : (r.k + 1) * width] += rate * np.clip(stretch(r.step, np.float32).reshape(width, CLASSES), -2, 2)
        shared.destroy()
    return weights, tokens, losses


def _blocks(cell: np.ndarray, n: np.ndarray, size: int = 4096):
    """(contexts, their counts by class as a dense block, first context) for sorted cells (context * CLASSES + class)."""
    ctx, back = np.unique(cell // CLASSES, return_inverse=True)
    for lo in range(0, len(ctx), size):
        own = ctx[lo : lo + size]
        i, j = np.searchsorted(back, [lo, lo + len(own)])
        obs = np.zeros((len(own), CLASSES), np.float32)
        obs[back[i:j] - lo, cell[i:j] % CLASSES] = n[i:j]
        yield own, obs, lo


def _scatter(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """total[rows] += values, rows repeated or not."""
    order = np.argsort(rows, kind="stable")
    s = rows[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    total[s[first]] += np.add.reduceat(values[order], first)


def train_histories(contexts: DataFrame, shape: Shape, weights, rounds: int = OWN_ROUNDS) -> DataFrame:
    """Stored (key, history, mixed, loss): each bucket's weights of its histories (rows of classes) and of its hashed rows; `weights`, a
    broadcast, holds those of class features, which stay."""
    width = shape.history_width

    def run(batches):
        for b in batches:
            for key, a, c in zip(*(b.column(i).to_pylist() for i in ("key", "a", "b")), strict=True):
                cell, n = stretch(a, np.int64), stretch(c, np.float64)
                own, mixed, rate, last = np.zeros((width, CLASSES), np.float32), np.zeros((CONTEXT_ROWS, CLASSES), np.float32), RATE, np.inf
                for _ in range(rounds):
                    sums = [np.zeros_like(x) for x in (own, own, mixed, mixed)]
                    loss = 0.0
                    for ctx, obs, _ in _blocks(cell, n, 2048):
                        h, two = ctx // CLASSES, ctx % CLASSES
                        place = own_rows(h, two)
                        logp = normalised(logits(weights.value, two * CLASSES + shape.class_of_history[h + key * width]) + own[h] + mixed[place])
                        loss -= float((obs * logp).sum(dtype=np.float64))
                        want = np.exp(logp) * obs.sum(1, keepdims=True)
                        obs -= want
                        for total, rows, v in zip(sums, (h, h, place, place), (obs, want, obs, want), strict=True):
                            _scatter(total, rows, v)
                    if loss > last:
                        rate /= 2
                    last = loss
                    own += rate * np.clip((sums[0] - HISTORY_PULL * own) / (sums[1] + DAMP), -2, 2)
                    mixed += rate * np.clip((sums[2] - HISTORY_PULL * mixed) / (sums[3] + DAMP), -2, 2)
                tidy()
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([squeeze(own)], pa.binary()), pa.array([squeeze(mixed)], pa.binary()), pa.array([last])], ["key", "history", "mixed", "loss"])

    return store(contexts.mapInArrow(run, "key int, history binary, mixed binary, loss double"), "lm-histories")


def train_pairs(pairs: DataFrame, shape: Shape, prior: np.ndarray, rounds: int = OWN_ROUNDS) -> DataFrame:
    """Stored (key, cells, norms, loss): each bucket's hashed weights of pairs, and for its words before the log of the sum over each class.
    prior: log share of each outcome in its class (-inf where the class has no such outcome)."""
    width, outs, by = shape.pair_width, shape.outcomes, shape.by_class
    have = np.unique(shape.class_of_outcome)
    cuts = shape.class_cuts[have]
    slot = np.searchsorted(have, shape.class_of_outcome[by])

    def run(batches):
        for b in batches:
            for key, a, c in zip(*(b.column(i).to_pylist() for i in ("key", "a", "b")), strict=True):
                cell, n = stretch(a, np.int64), stretch(c, np.int64)
                words = min(width, outs - key * width)
                weight, rate, last = np.zeros(PAIR_CELLS), RATE, np.inf
                place_of = np.empty(outs, np.int64)
                place_of[by] = np.arange(outs)
                used = np.unique(cell // outs)
                for turn in range(rounds + 1):
                    grad, seen, loss, norms = np.zeros(PAIR_CELLS), np.zeros(PAIR_CELLS), 0.0, np.zeros((width, CLASSES), np.float32)
                    for lo in range(0, words, 32):
                        w = np.arange(lo, min(words, lo + 32))
                        w = w[np.isin(w, used)] if turn < rounds else w
                        if not len(w):
                            continue
                        at = pair_cells((w + key * width)[:, None], by[None, :])
                        z = prior[by] + weight[at]
                        e = np.exp(z)
                        total = np.add.reduceat(e, cuts, axis=1)
                        if turn == rounds:
                            norms[np.ix_(w, have)] = np.log(np.maximum(total, 1e-30))
                            continue
                        obs = np.zeros((len(w), outs))
                        i, j = np.searchsorted(cell, [w[0] * outs, (w[-1] + 1) * outs])
                        obs[np.searchsorted(w, cell[i:j] // outs), place_of[cell[i:j] % outs]] = n[i:j]
                        each = np.add.reduceat(obs, cuts, axis=1)
                        e *= (each / np.maximum(total, 1e-30))[:, slot]
                        on = obs > 0
                        loss -= float((obs[on] * (z - np.log(np.maximum(total, 1e-30))[:, slot])[on]).sum())
                        grad += np.bincount(at.ravel(), (obs - e).ravel(), PAIR_CELLS)
                        seen += np.bincount(at.ravel(), e.ravel(), PAIR_CELLS)
                    if turn < rounds:
                        if loss > last:
                            rate /= 2
                        last = loss
                        weight += rate * np.clip((grad - PAIR_PULL * weight) / (seen + PAIR_DAMP), -2, 2)
                tidy()
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([squeeze(weight.astype(np.float32))], pa.binary()), pa.array([squeeze(norms)], pa.binary()), pa.array([last])], ["key", "cells", "norms", "loss"])

    return store(pairs.mapInArrow(run, "key int, cells binary, norms binary, loss double"), "lm-pairs")


@dataclass
class Model:
    """All that scoring needs but the counts of rarer words."""

    shape: Shape
    weights: np.ndarray
    history: np.ndarray  # histories x classes
    mixed: np.ndarray  # bucket x CONTEXT_ROWS x classes
    prior: np.ndarray
    cells: np.ndarray  # bucket x PAIR_CELLS
    norms: np.ndarray  # outcomes x classes
    within: np.ndarray  # log10 of tokens + types + 1 of the rarer words of each class

    def class_logs(self, history: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log P(class | history), a row a context."""
        z = logits(self.weights, two * CLASSES + self.shape.class_of_history[history])
        part = history // self.shape.history_width
        return normalised(z + self.history[history] + self.mixed[part, own_rows(history % self.shape.history_width, two)])

    def outcome_logs(self, last: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Natural log P(outcome | its class, word before)."""
        part = last // self.shape.pair_width
        return self.prior[out] + self.cells[part, pair_cells(last, out)] - self.norms[last, self.shape.class_of_outcome[out]]

    def token_logs(self, r: Row) -> np.ndarray:
        """Natural log P of each token of a row, as far as its outcome."""
        history = self.shape.history_of[r.last]
        ctx, back = np.unique(history * CLASSES + r.two, return_inverse=True)
        order = np.argsort(back, kind="stable")
        out = np.empty(len(r.x))
        bounds = np.searchsorted(back[order], np.arange(0, len(ctx) + 4096, 4096))
        for lo, (i, j) in zip(range(0, len(ctx), 4096), zip(bounds, bounds[1:], strict=False), strict=False):
            o, own = order[i:j], ctx[lo : lo + 4096]
            out[o] = self.class_logs(own // CLASSES, own % CLASSES)[back[o] - lo, r.x[o]]
        return out + self.outcome_logs(r.last, r.out)


def outcome_prior(shape: Shape, counts: np.ndarray, rare_tokens: np.ndarray, end: int) -> np.ndarray:
    """Log share of each outcome in its class, of counts with a half added: listed words, the rarer words of buckets, the end."""
    own = np.append(counts, rare_tokens).astype(np.float64) + 0.5
    own[shape.listed] = end + 0.5
    own[shape.listed + 1 : shape.listed + 1 + min(HEADS, shape.listed)] = 0  # classes of one word
    total = np.bincount(shape.class_of_outcome, own, CLASSES)
    with np.errstate(divide="ignore"):
        return np.log(own / np.maximum(total[shape.class_of_outcome], 1e-30))


@dataclass
class Fitted:
    """A model with what it was fitted on: listed words and their counts (and of texts), buckets of rarer words and what they said."""

    model: Model
    listed: list[str]
    counts: np.ndarray
    n_buckets: int
    said: DataFrame
    n_train: int
    types: int


def fit(packed: DataFrame) -> Fitted:
    """Counts, contexts and pairs of all packed rows, then both factors."""
    spark = packed.sparkSession
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    listed = common_words(packed)
    shape = Shape(len(listed), classes_of(listed))
    n_buckets = int(max(LEAST, total // BUCKET_BYTES))
    found = store(survey(packed, listed, shape, n_buckets), "lm-survey")
    contexts = store(added_up(found, 0, CONTEXT_PARTS, shape.history_width * CLASSES**2), "lm-contexts")
    pairs = store(added_up(found, 3, PAIR_PARTS, shape.pair_width * shape.outcomes), "lm-pair-counts")
    said = store(judge_words(found.where("kind = 2").select("key", "src", "a", "b")), "lm-words")
    counts = _listed_counts(found, len(listed))
    discard(found)
    rare = np.zeros(2 * CLASSES, np.int64)
    for r in said.where("src = -1").select("counts").collect():  # one row of 2 * CLASSES numbers a bucket
        rare += stretch(r.counts, np.int64)
    types, rare_tokens = rare[:CLASSES], rare[CLASSES:]
    weights, tokens, _ = train(store(class_contexts(contexts, shape), "lm-class-contexts"))
    prior = outcome_prior(shape, counts[:-1], rare_tokens, int(counts[-1]))
    history, mixed = np.zeros((CONTEXT_PARTS * shape.history_width, CLASSES), np.float32), np.zeros((CONTEXT_PARTS, CONTEXT_ROWS, CLASSES), np.float32)
    cells, norms = np.zeros((PAIR_PARTS, PAIR_CELLS), np.float32), np.zeros((PAIR_PARTS * shape.pair_width, CLASSES), np.float32)
    shared = spark.sparkContext.broadcast(weights)
    # CONTEXT_PARTS and PAIR_PARTS rows: the model, whose size is fixed. A bucket without any keeps noughts: shares as they are.
    for r in train_histories(contexts, shape, shared).collect():
        history[r.key * shape.history_width : (r.key + 1) * shape.history_width] = stretch(r.history, np.float32).reshape(-1, CLASSES)
        mixed[r.key] = stretch(r.mixed, np.float32).reshape(-1, CLASSES)
    for r in train_pairs(pairs, shape, prior).collect():
        cells[r.key] = stretch(r.cells, np.float32)
        norms[r.key * shape.pair_width : (r.key + 1) * shape.pair_width] = stretch(r.norms, np.float32).reshape(-1, CLASSES)
    shared.destroy()
    model = Model(shape, weights, history, mixed, prior.astype(np.float32), cells, norms, np.log10(rare_tokens + types + 1.0))
    return Fitted(model, listed, counts, n_buckets, said, int(tokens.sum()), int(types.sum() + (counts > 0).sum()))


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text."""
    packed = pack(docs, "lm-texts")
    return score_packed(packed, fit(packed))


def score_packed(packed: DataFrame, fitted: Fitted) -> DataFrame:
    listed, counts, n_buckets, n_train, v = fitted.listed, fitted.counts, fitted.n_buckets, fitted.n_train, fitted.types
    head_log = np.log10(counts + 1.0)
    sent = packed.sparkSession.sparkContext.broadcast(fitted.model)
    names, kinds = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(key, left, right):
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, kinds, strict=True)})
        r = Row(*(left.column(c)[0].as_py() for c in ("ids", "lens", "body")), pa.array(listed, pa.string()))
        m, seen = len(r.ids), np.zeros(len(r.w.vocab), np.int64)
        by, cut = r.rare(n_buckets)
        for p, x in zip(*(right.column(c).to_pylist() for c in ("bucket", "counts")), strict=True):
            seen[by[cut[p] : cut[p + 1]]] = stretch(x, np.int64)
        here = r.listed >= 0
        seen[here] = counts[r.listed[here]]
        own = np.log10(seen + 1.0)
        part = np.bincount(r.doc, own[r.w.codes], m) if len(r.w.codes) else np.zeros(m)
        known = (np.bincount(r.doc, seen[r.w.codes] > 0, m).astype(np.int64) if len(r.w.codes) else np.zeros(m, np.int64)) + int(counts[-1] > 0)
        base = part + head_log[-1] - r.n_tokens * np.log10(n_train + v + 1.0)
        tidy()
        token = sent.value.token_logs(r) / np.log(10)
        if len(r.w.codes):  # a rarer word's share of its outcome
            rarer = np.where(here, 0.0, own - sent.value.within[r.classes])
            token[r.at] += rarer[r.w.codes]
        score = np.add.reduceat(token, r.first[:-1])
        return pa.table(dict(zip(names, (id_array(r.ids), pa.array(~r.train), pa.array(r.n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(m, n_train), pa.int64()), pa.array(base), pa.array(score)), strict=True)))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.select("src", "ids", "lens", "body").groupBy("src").cogroup(fitted.said.where("src >= 0").groupBy("src")).applyInArrow(run, schema)


def _listed_counts(found: DataFrame, n: int) -> np.ndarray:
    """Training tokens of each listed word, then training texts."""

    def summed(batches):
        acc = np.zeros(n + 1, np.int64)
        for b in batches:
            for a in b.column("a").to_pylist():
                acc += stretch(a, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(acc)], pa.binary())], ["a"])

    lists = found.where("kind = 1").select("a")
    while lists.rdd.getNumPartitions() > 64:
        lists = store(lists.coalesce(max(64, lists.rdd.getNumPartitions() // 64)).mapInArrow(summed, "a binary"), "lm-lists")
    counts = np.zeros(n + 1, np.int64)
    for r in lists.mapInArrow(summed, "a binary").collect():  # 64 rows at most
        counts += stretch(r.a, np.int64)
    return counts


def op1_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
