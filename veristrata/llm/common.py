"""What the operators of this subpackage share: shared folders, Arrow text access, word and id extraction, packed documents.

Conventions that every operator follows unless its docstring says otherwise: a null text is an empty text; a null
``doc_id`` sorts after every other id (the largest of 64 bits ranks with it, where ids decide) and comes back as null; rows with equal ids are separate rows; columns that an
operator does not name are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.plans.checkpoint import discard, shared_dir, store  # noqa: F401

#: A null id inside numpy arrays.
NO_ID = np.iinfo(np.int64).max
#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 2 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings, but Arrow batches of texts that fit beside two workers in a small executor: 1000 rows, 4 MB.
    The caller's own session stays as it is."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return own_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def in_own_session(df: DataFrame) -> DataFrame:
    """The same rows in a session as of own_session."""
    name = f"own_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return own_session(df.sparkSession).table(f"{df.sparkSession.conf.get('spark.sql.globalTempDatabase')}.{name}")
    finally:
        df.sparkSession.catalog.dropGlobalTempView(name)


def tidy() -> None:
    """Gives free memory back to the system: Python workers are used again, stage after stage, and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.large_string() if pa.types.is_large_string(col.type) else pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


class Ids(np.ndarray):
    """Ids in order, null as NO_ID; `real`: which of those with that value are ids all the same (None: none is)."""

    real: np.ndarray | None = None

    def __array_finalize__(self, other):
        self.real = None  # it belongs to the whole array, not to parts of it


def long_values(col: pa.Array) -> Ids:
    """Ids as int64, null as NO_ID."""
    own = col.cast(pa.int64())
    out = pc.fill_null(own, NO_ID).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(Ids)
    real = (np.asarray(out) == NO_ID) & pc.is_valid(own).to_numpy(zero_copy_only=False)
    out.real = real if real.any() else None
    return out


def id_array(ids: np.ndarray) -> pa.Array:
    gone = np.asarray(ids) == NO_ID
    if getattr(ids, "real", None) is not None:
        gone &= ~ids.real
    return pa.array(np.asarray(ids), pa.int64(), mask=gone)


def id_bytes(ids: Ids) -> bytes:
    """The ids, and behind them which of them are real if some must be told from nulls."""
    return ids.tobytes() + (b"" if ids.real is None else ids.real.tobytes())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes of text; a longer text is a piece of its own."""
    for b in batches:
        if b.num_rows == 0:
            continue
        n = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(n) - n) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield b.slice(i, j - i)
    tidy()


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: `codes` into `vocab`, `off` words before each text, `starts` and `ends` bytes.
    cut: bytes that begin a word wherever they stand."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, cut: np.ndarray | None = None):
        if lower:
            data = _LOWER[data]
        self.data = data
        n = len(data)
        black = ~_WHITE[data]
        first = black.copy()
        first[1:] &= ~black[:-1]
        inner = offs[:-1][offs[:-1] < n]
        first[inner] = black[inner]
        if cut is not None:
            first[cut] = black[cut]
        self.starts = np.flatnonzero(first)
        self.off = np.searchsorted(self.starts, offs)
        limits = np.append(self.starts, n).astype(np.int32)
        arr = pa.BinaryArray.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(limits), pa.py_buffer(np.ascontiguousarray(data))])
        coded = arr.dictionary_encode()
        bare = pc.ascii_rtrim_whitespace(coded.dictionary.cast(pa.string())).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        again = bare.indices.to_numpy(zero_copy_only=False)
        self.codes = again[codes] if len(codes) else np.zeros(0, np.int32)
        self.vocab = bare.dictionary

    def ends(self) -> np.ndarray:
        lens = pc.binary_length(self.vocab).to_numpy(zero_copy_only=False)
        return self.starts + (lens[self.codes] if len(self.codes) else 0)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word of the vocabulary."""
        return hash_all(self.vocab)


def hash_all(strings: pa.Array, seed: int = 0) -> np.ndarray:
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x, seed) for x in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _C2
    x ^= x >> np.uint64(29)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _C1 + (b ^ (b >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + np.uint64(0x632BE59BD9B4E019))


def shifted_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive units at each start, from hashes of units; len(h) - n + 1 values."""
    parts, at, have, size = [], 0, h, 1
    left = n
    while left:
        if left & 1:
            parts.append((have, at))
            at += size
        left >>= 1
        if left:
            have = pair_hash(have[:-size], have[size:]) if len(have) > size else have[:0]
            size *= 2
    total = max(0, len(h) - n + 1)
    out = None
    for a, at in parts:
        x = a[at : at + total]
        out = x if out is None else pair_hash(out, x)
    return out if n > 1 else h


def crc(data: np.ndarray | bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def doc_crc(doc_id: str = "doc_id"):
    """crc32 of the id as text, as a Column."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


# ---- tokenizers -------------------------------------------------------------------------------------------------


def _visible() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next of U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in kept else chr(256 + n)
        n += b not in kept
    return out


_VISIBLE = _visible()
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


@cache
def tokenizer_of(path: str):
    """One tokenizer a worker: each load leaves some 5 MB behind in the tokenizer library's own allocations."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkCoder:
    """Token ids of whole texts, from one call of the tokenizer per distinct chunk.

    Texts are cut only where the tokenizer's own pre-tokenizer always cuts: before a blank that follows a character that is
    certainly not white space, between a Latin letter and a mark (no apostrophe, no |), and between a single line feed and a letter.
    So the ids are those of the whole text. Chunks of Latin letters alone are one pre-token and go straight to the tokenizer's
    model; others take the whole way. kind "words": a lower-casing vocabulary that drops white space. kind "bytes": a
    byte-level vocabulary whose pre-tokens may start with one blank. Ids of up to `keep` chunks stay in memory.
    """

    def __init__(self, path: str, kind: str, keep: int = 400_000):
        self.tok = tokenizer_of(path)
        self.model = self.tok.model
        self.kind, self.keep = kind, keep
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.seen: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.seen.clear()
        self.n, self.used = 0, 0
        self.at = np.zeros(1 << 16, np.int64)
        self.len = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)

    def _ids_of(self, chunks: list[bytes]) -> list[list[int]]:
        out, slow, whole, tokenize = [None] * len(chunks), [], _LETTERS.fullmatch, self.model.tokenize
        for i, c in enumerate(chunks):
            s = c.decode("utf-8")
            blank = s[:1] == " "
            if whole(s, 1 if blank else 0):
                if self.kind == "words":
                    s = s.lower().strip()
                if not s.isascii() or " " in s:
                    s = "".join([_VISIBLE[x] for x in s.encode()])
                out[i] = [t.id for t in tokenize(s)]
            else:
                slow.append(i)
        for i, e in zip(slow, self.tok.encode_batch_fast([chunks[i].decode("utf-8") for i in slow], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        for i in range(0, len(chunks), 20_000):
            part = chunks[i : i + 20_000]
            got = self._ids_of(part)
            lens = np.fromiter(map(len, got), np.int32, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum()))
            while self.n + len(part) > len(self.at):
                self.at, self.len = np.append(self.at, np.zeros_like(self.at)), np.append(self.len, np.zeros_like(self.len))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.append(self.ids, np.zeros_like(self.ids))
            self.at[self.n : self.n + len(part)] = self.used + np.cumsum(lens) - lens
            self.len[self.n : self.n + len(part)] = lens
            self.ids[self.used : self.used + len(flat)] = flat
            self.seen.update(zip(part, range(self.n, self.n + len(part)), strict=True))
            self.n += len(part)
            self.used += len(flat)

    def _lower(self, data: np.ndarray) -> np.ndarray:
        """ASCII lower case, unless that made or unmade one of the added tokens."""
        low = _LOWER[data]
        a, b = data.tobytes(), low.tobytes()
        return low if all(a.count(t) == b.count(t) for t in self.special) else data

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all texts, ids before each text)."""
        n = len(data)
        if self.kind == "words":
            data = self._lower(data)
        solid = (data > 32) & (data < 127)
        letter = ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
        latin = np.zeros(n, bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        mark = solid & ~letter & ~((data >= 48) & (data <= 57)) & (data != 39) & (data != 124)  # | ends added tokens
        cut = np.zeros(n, bool)
        cut[1:] = ((data[1:] == 32) & (solid | latin)[:-1]) | (mark[1:] & (letter | latin)[:-1])
        cut[2:] |= letter[2:] & (data[1:-1] == 10) & solid[:-2]
        inner = offs[:-1][offs[:-1] < n]
        cut[inner] = True
        starts = np.flatnonzero(cut)
        before = np.searchsorted(starts, offs)
        arr = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, n).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = arr.dictionary_encode()
        vocab, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if self.n + len(vocab) > self.keep and self.n:
            self._clear()
        new = [c for c in vocab if c not in self.seen]
        if new:
            self._learn(new)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        slot = np.fromiter(map(self.seen.__getitem__, vocab), np.int64, len(vocab))[codes]
        lens = self.len[slot].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1])
        first = self.at[slot] - (ends - lens)
        ids = self.ids[np.repeat(first, lens) + np.arange(total)]
        return ids, np.append(0, ends)[before]


# ---- packed documents -------------------------------------------------------------------------------------------

PACKED = "src long, n long, bytes long, ids binary, lens binary, body binary, rest binary"


def pack(docs: DataFrame, name: str, limit: int = SLICE_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Stored rows of about `limit` bytes of text each, compressed: what later steps send and reread instead of single texts.

    `src` is fixed in the stored rows, so every later step names the same documents by it. keep: other columns that travel
    along, in `rest`.
    """
    names = [f"keep{i}" for i in range(len(keep or []))]

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        part, k, z = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for b in slices(batches, limit=limit):
            data, offs = text_buffers(b.column("text"))
            ids = long_values(b.column("doc_id"))
            yield pa.RecordBatch.from_pydict(
                {"src": pa.array([(part << 32) + k], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "ids": pa.array([id_bytes(ids)], pa.binary()), "lens": pa.array([np.diff(offs).tobytes()], pa.binary()), "body": pa.array([z.compress(data.tobytes())], pa.binary()), "rest": pa.array([_to_ipc(b.select(names)) if names else None], pa.binary())}
            )
            k += 1

    rest = [F.col(f"`{c}`").alias(n) for c, n in zip(keep or [], names, strict=True)]
    return store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest).mapInArrow(write, PACKED), name)


def _to_ipc(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def rest_of(raw: bytes | None) -> list[pa.Array]:
    """The kept columns of a packed row."""
    return [c.combine_chunks() for c in pa.ipc.open_stream(raw).read_all().columns] if raw is not None else []


def unpack(ids: bytes, lens: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes of the texts, offsets)."""
    import zstandard

    offs = np.append(0, np.cumsum(np.frombuffer(lens, np.int64)))
    n = len(offs) - 1
    own = np.frombuffer(ids, np.int64, n).view(Ids)
    if len(ids) > 8 * n:
        own.real = np.frombuffer(ids, bool, n, 8 * n)
    return own, np.frombuffer(zstandard.decompress(body) if len(body) else b"", np.uint8), offs


def squeeze(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def stretch(b: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(b), dtype)
