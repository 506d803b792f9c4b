"""Operator 10, token-id output: directly addressable codes.

An id is split into chunks of LEVEL_BITS, lowest first. Level 0 holds the first chunk of every id; a continuation bit says
whether the id goes on in the next level, where its place is the rank of that bit. A directory of ranks, one entry for
RANK_BITS bits, makes any id readable alone: its chunk, its bit, one rank, and so on upwards.

A file: magic, number of ids, documents and levels, then first id of each document, then for each level its width in bits,
length, chunks, continuation bits and rank directory. Files lie in the shared folder, one for FILE_BYTES of text, and a stored
manifest names them in order; a task that is repeated writes files of other names, and only those of the attempt that Spark
commits are named. Documents are read by the places of their ids: ranks lead to their part of each level.

Null and empty texts hold the end id only; rows with equal or null ids are files' rows like any others (nulls last).
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm import files
from veristrata.llm.common import ChunkCoder, crc, shared_dir, slices, store, table, text_buffers, tidy

MAGIC = b"DAC1"
LEVEL_BITS = (8, 8, 16)
RANK_BITS = 512
END_ID = 2
#: Bytes of text that one stored file holds.
FILE_BYTES = 4 << 20
#: Bytes of text of a range of ids, about.
RANGE_BYTES = 64 << 20


def build(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file of some ids; starts: place of each document's first id."""
    out, rest, levels, shift = [], ids.astype(np.uint32), [], 0
    for k, width in enumerate(LEVEL_BITS):
        chunk = (rest & np.uint32((1 << width) - 1)).astype(np.uint8 if width <= 8 else np.uint16)
        more = (rest >> np.uint32(width)) > 0 if k + 1 < len(LEVEL_BITS) else np.zeros(len(rest), bool)
        levels.append((width, chunk, more))
        rest = rest[more] >> np.uint32(width)
        shift += width
        if not len(rest):
            break
    if len(rest) and shift < 32 and (rest >> np.uint32(32 - shift)).any():
        raise ValueError("an id is too large for the levels")
    out.append(MAGIC + struct.pack("<QQB", len(ids), len(starts), len(levels)) + starts.astype("<u8").tobytes())
    for width, chunk, more in levels:
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(blocks) - blocks).astype("<u4")
        out.append(struct.pack("<BQ", width, len(chunk)) + chunk.astype(chunk.dtype.newbyteorder("<")).tobytes() + bits.tobytes() + ranks.tobytes())
    return b"".join(out)


class Dac:
    """A file: len(), any id by place, any document, or all ids."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n, docs, levels = struct.unpack_from("<QQB", blob, 4)
        at = 4 + 17
        self.starts = np.frombuffer(blob, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.levels = []
        for _ in range(levels):
            width, n = struct.unpack_from("<BQ", blob, at)
            at += 9
            chunk = np.frombuffer(blob, "u1" if width <= 8 else "<u2", n, at)
            at += chunk.nbytes
            bits = np.frombuffer(blob, "u1", -(-n // 8), at)
            at += bits.nbytes
            ranks = np.frombuffer(blob, "<u4", -(-n // RANK_BITS), at)
            at += ranks.nbytes
            self.levels.append((width, chunk, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out, shift = 0, 0
        for width, chunk, bits, ranks in self.levels:
            out |= int(chunk[i]) << shift
            shift += width
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            own = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(ranks[block]) + int(own.sum())
        return out

    def all(self) -> np.ndarray:
        """Every id: the levels from the last to the first."""
        high = None
        for width, chunk, bits, _ in reversed(self.levels):
            out = chunk.astype(np.uint32)
            if high is not None and len(high):
                more = np.unpackbits(bits, bitorder="little")[: len(chunk)].astype(bool)
                out[more] |= high << np.uint32(width)
            high = out
        return high if high is not None else np.zeros(0, np.uint32)

    def ranks(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many ids before each of these places of a level go on in the next: the directory's entry, and the bits since."""
        _, chunk, bits, ranks = self.levels[level]
        block = np.minimum(at // RANK_BITS, max(0, len(ranks) - 1))
        byte = block[:, None] * (RANK_BITS // 8) + np.arange(RANK_BITS // 8)
        whole = (at >> 3)[:, None] - byte
        own = np.where((whole >= 0) & (byte < len(bits)), bits[np.minimum(byte, max(0, len(bits) - 1))] if len(bits) else np.zeros((1, 1), np.uint8), np.uint8(0))
        own = np.where(whole == 0, own & ((1 << (at & 7)) - 1).astype(np.uint8)[:, None], own)
        return (ranks[block].astype(np.int64) if len(ranks) else np.zeros(len(at), np.int64)) + np.bitwise_count(own).sum(1, dtype=np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, each by its own way through the levels."""
        out, on, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), 0
        at = np.asarray(places, np.int64)
        for k, (width, chunk, bits, _) in enumerate(self.levels):
            out[on] |= chunk[at].astype(np.uint32) << np.uint32(shift)
            shift += width
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            on, at = on[more], at[more]
            if not len(on):
                break
            at = self.ranks(k, at)
        return out

    def between(self, first: int, stop: int) -> np.ndarray:
        """The ids at places first to stop - 1: their stretch of each level, found by rank; nothing else is read."""
        parts, a, b = [], first, stop
        for k, (width, chunk, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            more = np.unpackbits(bits[a >> 3 : -(-b // 8)], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            parts.append((width, chunk[a:b], more))
            a = int(self.ranks(k, np.array([a]))[0])
            b = a + int(more.sum())
        high = np.zeros(0, np.uint32)
        for width, chunk, more in reversed(parts):
            out = chunk.astype(np.uint32)
            if len(high):
                out[more] |= high << np.uint32(width)
            high = out
        return high

    def document(self, k: int) -> np.ndarray:
        stop = int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.n
        return self.between(int(self.starts[k]), stop)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files in ascending id order; their stored manifest: (part, seq, n_ids, doc_ids, path).

    Texts are dealt out by ranges of doc_id (and for rows of one id, of the hash of their texts) and sorted within them; ids are made after that, so only texts travel.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    files.check(folder)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        coder, part, seq = ChunkCoder(tokenizer, "bytes"), task.partitionId(), 0
        for b in slices(batches, limit=file_bytes):
            ids, offs = coder.encode(*text_buffers(b.column("text")))
            n = len(offs) - 1
            out = np.full(len(ids) + n, end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offs))] = ids
            path = f"{folder}/{part:06d}-{seq:06d}-{task.taskAttemptId()}.dac"
            files.put(path, build(out, offs[:-1] + np.arange(n)))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(out)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column("doc_id")), pa.array([path])], ["part", "seq", "n_ids", "doc_ids", "path"])
            seq += 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]  # rows of one id have an order too, and may be dealt to several ranges
    dealt = texts.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return store(dealt.mapInArrow(run, "part long, seq long, n_ids long, doc_ids array<long>, path string"), "token-manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with `before`: the ids in all files before each. Totals of parts, a row a part, pass one task; files only meet those of
    their own part."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("before", F.col("base") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).drop("base")


def read_ids(manifest: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that a manifest names."""

    def run(batches):
        for b in batches:
            for before, raw, path in zip(b.column("before").to_pylist(), b.column("doc_ids"), b.column("path").to_pylist(), strict=True):
                d = Dac(files.get(path))
                stops = np.append(d.starts[1:], d.n)
                if (d.at(stops - 1) != end_id).any():
                    raise ValueError(f"a document of {path} doesn't end with id {end_id}")
                sums = [crc(memoryview(d.document(k).astype("<u4")).cast("B")) for k in range(len(d.starts))]
                yield pa.RecordBatch.from_arrays([raw.values, pa.array(before + d.starts), pa.array(stops - d.starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
            tidy()

    return placed(manifest).select("before", "doc_ids", "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_dac(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
