"""Windows of K consecutive units (words or bytes) that also start in a document with a smaller id: the shared frame of
operators 5 and 9.

1. Documents are stored packed (common.pack). Each window gets a minimiser: the smallest hash among the runs of M units in
   it. Equal windows have equal minimisers.
2. Which minimisers two documents or more have is asked of buckets (exchange).
3. Consecutive windows with one such minimiser travel as one packed string to its shard, each distinct string of a packed
   row once, with the smallest and largest id that has it. Windows of a minimiser that very many packed rows share (HOT)
   travel singly, dealt out by their own content, and are first made one for each FOLD packed rows: a shard gets no more
   copies of a window than there are such folds, and a fold no more than FOLD.
4. A shard finds equal windows by sorting (how is the operator's part) and sends back, to each packed row or fold, runs of
   windows with the smallest id that has them, where that can matter. Folds pass it on to their packed rows.
5. Each packed row marks what is covered.

Every exchange is keyed by bucket, shard, fold or packed row; their number follows the bytes of text, so groups stay bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import Words, mix, pack, pair_hash, rest_of, shifted_hash, squeeze, store, stretch, tidy, unpack
from veristrata.llm.exchange import Exchange, answers_of, spread

K, M = 50, 16
#: Bytes of text for a shard of strings, and the fewest shards.
SHARD_BYTES, LEAST = 4 << 20, 24
#: Level (1 + log2 of the packed rows that share it) from which a minimiser's windows travel singly.
HOT = 10
#: Packed rows whose hot windows meet before they go to a shard.
FOLD = 4096
#: Windows whose minimisers are worked out together.
TILE = 1 << 14

U = np.uint64


@dataclass
class Units:
    """Units of some texts: `off` units before each text, `low` the smallest hash among the runs of M units in the window of K units from
    each unit on (for as many units as have one), byte `starts` and `ends`."""

    off: np.ndarray
    low: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None


def sliding_minima(x: np.ndarray, span: int) -> np.ndarray:
    """The smallest of `span` consecutive numbers from each on."""
    size = 1
    while 2 * size <= span and len(x) > size:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (span - size)], x[span - size :]) if size < span < len(x) + size else x if size == span else x[:0]


def word_units(data: np.ndarray, offs: np.ndarray) -> Units:
    w = Words(data, offs)
    h = w.hashes()[w.codes] if len(w.codes) else np.zeros(0, U)
    return Units(w.off, sliding_minima(shifted_hash(h, M), K - M + 1), w.starts, w.ends())


def _eights(x: np.ndarray) -> np.ndarray:
    """Eight bytes from each on, as a number."""
    x = x.astype(np.uint16)
    x = (x[:-1] << np.uint16(8)) | x[1:]
    x = x.astype(np.uint32)
    x = (x[:-2] << np.uint32(16)) | x[2:]
    x = x.astype(U)
    return (x[:-4] << U(32)) | x[4:]


def byte_units(data: np.ndarray, offs: np.ndarray) -> Units:
    """In tiles that stay in a core's cache."""
    low = np.empty(max(0, len(data) - K + 1), U)
    for a in range(0, len(low), TILE):
        x = _eights(data[a : a + TILE + K - 1])
        own = sliding_minima(pair_hash(x[:-8], x[8:]), K - M + 1)
        low[a : a + TILE] = own[: len(low) - a]
    return Units(offs, low, None, None)


def runs_of(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, windows) of each maximal run of windows within a text that share a minimiser."""
    valid = np.zeros(len(u.low), bool)
    for a, b in zip(u.off[:-1].tolist(), (u.off[1:] - (K - 1)).tolist(), strict=True):
        if b > a:
            valid[a:b] = True
    if not len(valid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = ~(valid[1:] & valid[:-1]) | (u.low[1:] != u.low[:-1])
    first, last = valid.copy(), valid.copy()
    first[1:] &= apart
    last[:-1] &= apart
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) - start + 1


SENT = "shard int, hot boolean, src long, n int, index binary, lens binary, wins binary, lo binary, hi binary, body binary"


class Strings:
    """What some sent rows hold: for each string its row, place in it, windows, smallest and largest id; `which` of the distinct
    strings, in byte order, it is."""

    def __init__(self, t: pa.Table):
        n = t.column("n").to_numpy()
        cat = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
        self.src = t.column("src").to_numpy()
        self.index, self.lens, self.wins, self.lo, self.hi = cat("index", np.int32), cat("lens", np.int32).astype(np.int64), cat("wins", np.int32).astype(np.int64), cat("lo", np.int64), cat("hi", np.int64)
        self.row = np.repeat(np.arange(len(n)), n)
        view, ends = np.concatenate([stretch(x, np.uint8) for x in t.column("body").to_pylist()]).tobytes(), np.cumsum(self.lens)
        found = [view[e - m : e] for e, m in zip(ends.tolist(), self.lens.tolist(), strict=True)]
        self.distinct = sorted(set(found))
        slot = dict(zip(self.distinct, range(len(self.distinct)), strict=True))
        self.which = np.fromiter(map(slot.__getitem__, found), np.int64, len(found))


def folded(hot: DataFrame, folds: int) -> DataFrame:
    """The sent rows of each shard and fold as one row: each window once, with the smallest and largest id that has it."""

    def run(key, t):
        s = Strings(t)
        order, _, first = spread(s.which)
        lens = np.fromiter(map(len, s.distinct), np.int32, len(s.distinct))
        row = (key[0].as_py(), True, -1 - (key[0].as_py() * folds + key[1].as_py()), len(lens), np.arange(len(lens), dtype=np.int32).tobytes(), lens.tobytes(), np.ones(len(lens), np.int32).tobytes(), np.minimum.reduceat(s.lo[order], first).tobytes(), np.maximum.reduceat(s.hi[order], first).tobytes(), squeeze(np.frombuffer(b"".join(s.distinct), np.uint8)))
        kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int32()] + [pa.binary()] * 6
        tidy()
        return pa.table({c.split()[0]: pa.array([v], t) for c, v, t in zip(SENT.split(", "), row, kinds, strict=True)})

    return hot.groupBy("shard", "fold").applyInArrow(run, SENT)


def unfolded(hot: DataFrame, answers: DataFrame, folds: int) -> DataFrame:
    """The answers to folds, passed on to their packed rows: (src, answer)."""

    def run(key, left, right):
        out = {"src": [], "answer": []}
        if left.num_rows and right.num_rows:
            s = Strings(left)
            value = np.full(len(s.distinct), np.iinfo(np.int64).max)
            for x in right.column("answer").to_pylist():
                index, _, _, v = stretch(x, np.int64).reshape(4, -1)
                value[index] = v
            own = value[s.which]
            for r in np.unique(s.row[own < s.hi]).tolist():
                i = np.flatnonzero((s.row == r) & (own < s.hi))
                out["src"].append(int(s.src[r]))
                out["answer"].append(squeeze(np.concatenate([s.index[i].astype(np.int64), np.zeros(len(i), np.int64), np.ones(len(i), np.int64), own[i]])))
        tidy()
        return pa.table({"src": pa.array(out["src"], pa.int64()), "answer": pa.array(out["answer"], pa.binary())})

    own = hot.withColumn("to", -1 - (F.col("shard").cast("long") * folds + F.col("fold")))
    return own.groupBy("to").cogroup(answers.withColumnRenamed("src", "to").groupBy("to")).applyInArrow(run, "src long, answer binary")


def _bucket(mini: np.ndarray, n: int) -> np.ndarray:
    return (mix(mini) % U(n)).astype(np.int64)


def mark_windows(docs: DataFrame, unit: Callable, equal: Callable, finish: Callable, schema, name: str, keep: list[str] | None = None) -> DataFrame:
    """unit(data, offs) gives Units; equal(strings, lo, windows) gives for each window of the strings the smallest lo that
    has it; finish(ids, data, offs, units, covered, rest) gives a table of `schema` for the documents of a
    packed row; rest: their columns `keep`."""
    packed = pack(docs, name, keep=keep)
    size = packed.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).first()
    total = size.bytes or 0
    exchange, n_shards, folds = Exchange(total), max(LEAST, total // SHARD_BYTES), max(1, size.rows // FOLD)

    def distinct(u: Units):
        """The runs of a packed row, its distinct minimisers and the number of each run's."""
        start, wins = runs_of(u)
        order, keys, first = spread(u.low[start])
        group = np.empty(len(start), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(start))))
        return start, wins, order, keys, first, group

    def keys_of(ids, data, offs):
        u = unit(data, offs)
        start, _, order, keys, first, _ = distinct(u)
        if not len(keys):
            return keys, keys
        who = ids[np.searchsorted(u.off, start, "right") - 1][order]
        return keys, np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)

    known = exchange.shared(packed, keys_of, name + "-shared")

    def pieces(data, u: Units, told: list[tuple[int, bytes]]):
        """Runs to send from a packed row: first unit, windows, document, number of its string; and of each distinct string a run,
        its byte range and shard. The same call gives the same again when the answers come."""
        start, wins, _, keys, _, group = distinct(u)
        heat = exchange.levels(keys, told)[group]
        hit = heat > 0
        start, wins, hot, mini = start[hit], wins[hit], heat[hit] >= HOT, keys[group[hit]]
        if hot.any():  # single windows
            n = np.where(hot, wins, 1)
            one = np.repeat(hot, n)
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start, wins, mini, hot = np.repeat(start, n) + step * one, np.where(one, 1, np.repeat(wins, n)), np.repeat(mini, n), one
        doc = np.searchsorted(u.off, start, "right") - 1
        a = u.starts[start] if u.starts is not None else start
        b = u.ends[start + wins + K - 2] if u.starts is not None else start + wins + K - 1
        import xxhash

        view, h = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        key = np.fromiter((h(view[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), U, len(a))
        shard = _bucket(np.where(hot, mix(key), mini), n_shards)
        order, _, first = spread(pair_hash(key, mini))
        return start, wins, doc, order, first, a, b, 2 * shard + hot

    def send(key, left, right):
        out = {"shard": [], "hot": [], "src": [], "n": [], "index": [], "lens": [], "wins": [], "lo": [], "hi": [], "body": []}
        if left.num_rows and right.num_rows:
            ids, data, offs, u, told = _open(left, right, unit)
            start, wins, doc, order, first, a, b, shard = pieces(data, u, told)
            if len(start):
                who = ids[doc][order]
                lo, hi = np.minimum.reduceat(who, first), np.maximum.reduceat(who, first)
                one = order[first]
                by = np.argsort(shard[one])
                cut = np.searchsorted(shard[one][by], np.arange(2 * n_shards + 1))
                for p in np.flatnonzero(np.diff(cut)):
                    i = by[cut[p] : cut[p + 1]]
                    a_, n_ = a[one[i]], b[one[i]] - a[one[i]]
                    take = np.repeat(a_ - (np.cumsum(n_) - n_), n_) + np.arange(int(n_.sum()))
                    for c, v in zip(out, (int(p) // 2, bool(p % 2), int(key[0].as_py()), len(i), i.astype(np.int32).tobytes(), n_.astype(np.int32).tobytes(), wins[one[i]].astype(np.int32).tobytes(), lo[i].tobytes(), hi[i].tobytes(), squeeze(data[take])), strict=True):
                        out[c].append(v)
        kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int32()] + [pa.binary()] * 6
        tidy()
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    sent = packed.select("src", "ids", "lens", "body", "rest").groupBy("src").cogroup(known.groupBy("src")).applyInArrow(send, SENT)

    def judge(t):
        s = Strings(t)
        row, index, which, hi = s.row, s.index, s.which, s.hi
        order, _, first = spread(which)
        least = np.minimum.reduceat(s.lo[order], first)
        w = s.wins[order[first]]
        best = equal(s.distinct, least, w)  # a window after the other
        # runs of equal answers in each distinct string
        base = np.cumsum(w) - w
        new = np.append(True, best[1:] != best[:-1])
        new[base] = True
        rs = np.flatnonzero(new)
        rl = np.diff(np.append(rs, len(best)))
        of = np.searchsorted(base, rs, "right") - 1
        value, rs = best[rs], rs - base[of]
        k0 = np.searchsorted(of, np.arange(len(w) + 1))
        # for each string as it came: the runs that matter to it
        many = (k0[which + 1] - k0[which])
        j = np.repeat(k0[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        src_of = np.repeat(np.arange(len(which)), many)
        on = value[j] < hi[src_of]
        j, src_of = j[on], src_of[on]
        cut = np.searchsorted(row[src_of], np.arange(len(s.src) + 1))
        have = np.flatnonzero(np.diff(cut))
        tidy()
        made = [np.concatenate([index[src_of[cut[r] : cut[r + 1]]].astype(np.int64), rs[j[cut[r] : cut[r + 1]]], rl[j[cut[r] : cut[r + 1]]], value[j[cut[r] : cut[r + 1]]]]) for r in have]
        return pa.table({"src": pa.array(s.src[have], pa.int64()), "answer": pa.array([squeeze(x) for x in made], pa.binary())})

    if folds > 1:
        sent = store(sent, name + "-sent")
        hot = sent.where("hot").withColumn("fold", F.pmod(F.xxhash64("src"), F.lit(folds)))
        both = sent.where("not hot").unionAll(folded(hot, folds))
        made = store(both.groupBy("shard").applyInArrow(judge, "src long, answer binary"), name + "-judged")
        answers = made.where("src >= 0").unionAll(unfolded(hot, made.where("src < 0"), folds))
    else:
        answers = sent.groupBy("shard").applyInArrow(judge, "src long, answer binary")
    # one row of replies for each packed row: what was known, and what the shards said
    replies = known.withColumn("answer", F.lit(None).cast("binary")).unionByName(answers.select("src", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("heat"), "answer"))

    def cover(key, left, right):
        if not left.num_rows:
            return finish(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64), unit(np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(0, bool), [])
        ids, data, offs, u, told = _open(left, right, unit)
        tidy()
        mark = np.zeros(int(u.off[-1]) + 1, np.int64)
        made = [stretch(x, np.int64).reshape(4, -1) for x in (right.column("answer").to_pylist() if right.num_rows else []) if x is not None]
        if made:
            start, wins, doc, order, first, *_ = pieces(data, u, told)
            index, rs, rl, value = np.concatenate(made, axis=1)
            size = np.diff(np.append(first, len(order)))
            many = size[index]
            j = order[np.repeat(first[index] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            i = np.repeat(np.arange(len(index)), many)
            on = value[i] < ids[doc[j]]
            j, i = j[on], i[on]
            begin = start[j] + rs[i]
            np.add.at(mark, begin, 1)
            np.add.at(mark, begin + rl[i] + K - 1, -1)
        return finish(ids, data, offs, u, np.cumsum(mark[:-1]) > 0, rest_of(left.column("rest")[0].as_py()))

    return packed.select("src", "ids", "lens", "body", "rest").groupBy("src").cogroup(replies.groupBy("src")).applyInArrow(cover, schema)


def _open(left: pa.Table, right: pa.Table, unit: Callable):
    ids, data, offs = unpack(*(left.column(c)[0].as_py() for c in ("ids", "lens", "body")))
    return ids, data, offs, unit(data, offs), answers_of(right)
