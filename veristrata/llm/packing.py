"""Operator 4, best-fit packing by exact-complement hashing.

The plan is made on counts of lengths alone: at most `size` numbers, whatever the corpus. Pieces then look their place up
by (length, rank among the pieces of that length); ranks come from counts by stored partition, so no length, however
common, meets in one task. A null text is an empty document (its end id alone); rows with equal ids are packed each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import ChunkCoder, crc, slices, store, table, text_buffers

SIZE = 4096
#: How long the longest length of an exact fill must be, as a share of the one that best fit would take: one plan each.
SHARES = (0.0, 0.8, 0.95, 1.0)
END_ID = 1


class _Plan:
    """Segments: pieces of `length` with ranks r0 .. r0+m-1 lie at `offset` of sequences base .. base+m-1."""

    def __init__(self, counts: np.ndarray):
        self.rank = np.zeros(len(counts), np.int64)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.next = 0

    def lay(self, length: int, m: int, base: int, offset: int) -> None:
        self.rows.append((length, int(self.rank[length]), m, base, offset))
        self.rank[length] += m

    def open(self, lengths: list[int], m: int) -> int:
        base, at = self.next, 0
        for x in lengths:
            self.lay(x, m, base, at)
            at += x
        self.next += m
        return base

    def arrays(self) -> np.ndarray:
        a = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return a


class Sums:
    """An index of the available lengths by sum: how often each total is one length, two or three (in every order).

    A length that runs out leaves all three by a few shifted vector operations, so nothing is ever counted anew. Counts
    say where a combination can be; which lengths it has, and whether there are pieces enough of each, is looked up then.
    """

    def __init__(self, avail: np.ndarray):
        self.avail, self.size = avail, len(avail) - 1
        self.one = (avail > 0).astype(np.int64)
        width = 4 * len(avail)
        spectrum = np.fft.rfft(self.one.astype(np.float64), width)
        self.two = np.rint(np.fft.irfft(spectrum**2, width))[: len(avail)].astype(np.int64)
        self.three = np.rint(np.fft.irfft(spectrum**3, width))[: len(avail)].astype(np.int64)

    def take(self, lengths: dict[int, int], m: int) -> None:
        """m pieces of each length, times its number, go."""
        for x, n in lengths.items():
            self.avail[x] -= n * m
            if not self.avail[x]:
                self._drop(x)

    def _drop(self, x: int) -> None:
        one, two = self.one, self.two
        self.three[x:] -= 3 * two[: self.size + 1 - x]
        if 2 * x <= self.size:
            self.three[2 * x :] += 3 * one[: self.size + 1 - 2 * x]
        if 3 * x <= self.size:
            self.three[3 * x] -= 1
        two[x:] -= 2 * one[: self.size + 1 - x]
        if 2 * x <= self.size:
            two[2 * x] += 1
        one[x] = 0

    def fill(self, gap: int, many: int, held: dict[int, int], share: float = 0.0) -> list[int] | None:
        """`many` available lengths (1 to 3) that add up to gap, longest first, besides the pieces in `held`. The longest of them is at
        least `share` of the longest length that fits the gap at all."""
        if gap < many or not (self.one, self.two, self.three)[many - 1][gap]:
            return None
        left = lambda x: self.avail[x] - held.get(x, 0)
        if many == 1:
            return [gap] if left(gap) > 0 else None
        least = -(-gap // many)
        if share:
            fits = np.flatnonzero(self.one[: gap + 1])
            least = max(least, int(share * fits[-1])) if len(fits) else least
        b = np.arange(gap - many + 1, least - 1, -1)
        rest = self.one if many == 2 else self.two
        for x in b[(self.one[b] > 0) & (rest[gap - b] > 0)].tolist():
            if left(x) > 0 and (own := self.fill(gap - x, many - 1, held | {x: held.get(x, 0) + 1})):
                return [x, *own]
        return None


def plan_lengths(counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Segments (length, first rank, pieces, first sequence, offset) for counts[length] pieces of each length up to size.

    From the longest length down, the gap beside it is filled exactly by one, two or three others, each combination as often
    as its scarcest length allows; what no combination fills goes best fit, longest first, into the smallest gap. An exact
    fill by many short lengths can leave long ones without partners. So a plan is made for each of SHARES, and the shortest
    stands; with a share of 1, a fill begins with the length that best fit would take and completes it.
    """
    return min((_plan_from(counts, size, share) for share in SHARES), key=lambda p: p.next).arrays()


def _plan_from(counts: np.ndarray, size: int, share: float) -> _Plan:
    avail = np.zeros(size + 1, np.int64)
    avail[: len(counts)] = counts
    plan, index = _Plan(avail), Sums(avail)
    if avail[size]:
        m = int(avail[size])
        plan.open([size], m)
        index.take({size: 1}, m)
    for a in range(size - 1, 0, -1):
        while avail[a]:
            found = next((f for k in (1, 2, 3) if (f := index.fill(size - a, k, {a: 1}, share))), None)
            if not found:
                break
            need: dict[int, int] = {}
            for x in [a, *found]:
                need[x] = need.get(x, 0) + 1
            m = min(int(avail[x]) // n for x, n in need.items())
            plan.open([a, *found], m)
            index.take(need, m)
    open_by_gap: dict[int, list[tuple[int, int]]] = {}
    gaps = np.zeros(size + 1, np.int64)
    for a in range(size, 0, -1):
        n = int(avail[a])
        while n:
            fits = np.flatnonzero(gaps[a:])
            if len(fits):
                g = a + int(fits[0])
                base, m = open_by_gap[g].pop()
                gaps[g] -= 1
            else:  # as many new sequences as it takes
                g, m = size, -(-n // (size // a))
                base, plan.next = plan.next, plan.next + m
            each = g // a  # a sequence that a piece went into stays the best fit while another fits
            for many, bins in ((each, min(m, n // each)), (n % each if n // each < m else 0, 1)):
                if many and bins:
                    for t in range(many):
                        plan.lay(a, bins, base, size - g + t * a)
                    _add(open_by_gap, gaps, g - many * a, base, bins)
                    base, m, n = base + bins, m - bins, n - many * bins
            if m:
                _add(open_by_gap, gaps, g, base, m)
    return plan


def _add(open_by_gap: dict, gaps: np.ndarray, gap: int, base: int, m: int) -> None:
    if gap:
        open_by_gap.setdefault(gap, []).append((base, m))
        gaps[gap] += 1


def pieces_of(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Stored pieces: doc_id, piece, start, length, ids_crc32, and (part, rank) that number equal lengths in a task."""

    def run(batches):
        from pyspark import TaskContext

        coder, part, seen = ChunkCoder(tokenizer, "words"), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in slices(batches):
            ids, offs = coder.encode(*text_buffers(b.column("text")))
            n = len(offs) - 1
            out = np.full(len(ids) + n, end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offs))] = ids
            total = np.diff(offs) + 1
            first = np.append(0, np.cumsum(total))[:-1]
            k = -(-total // size)
            doc = np.repeat(np.arange(n), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * size
            length = np.minimum(size, total[doc] - start)
            at = first[doc] + start
            view = memoryview(out).cast("B")
            sums = [crc(view[4 * i : 4 * j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            s = length[order]
            new = np.append(True, s[1:] != s[:-1])
            rank = np.empty(len(s), np.int64)
            rank[order] = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            rank += seen[length]
            seen += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(doc), part)), pa.array(rank)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store(texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"), "pieces")


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[r.length] = r.n
    plan = plan_lengths(counts, size)
    length_of, rank_of, _, base_of, offset_of = (plan[:, i].copy() for i in range(5))
    key_of = (length_of << 48) + rank_of
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key_of, (length << 48) + rank, "right") - 1
            seq = base_of[i] + rank - rank_of[i] if len(length) else np.zeros(0, np.int64)
            off = offset_of[i] if len(length) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # counts are the smaller side: at most `size` a part, hashed without sorting the pieces
    ranked = pieces.join(before.hint("shuffle_hash"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    return pack_pieces(pieces_of(docs, tokenizer, size, end_id), size)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
