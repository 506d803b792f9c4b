"""Operator 8, media columns: FLAC. Texts become lossless 8-bit streams, and streams come back as PCM blocks with sample offsets.

Bytes become samples by a fixed one-to-one companding table. A null or empty text is one block of blanks. Equal texts give
equal streams. Every stream is self-contained, so rows need
no shuffle, and a lost task repeats its own rows only. The query stores the streams, reads them back, and takes what it
says of them from their PCM blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm import flac
from veristrata.llm.common import crc, slices, store, table, text_buffers, tidy

#: Bytes that a worker encodes or decodes at a time.
MEDIA_SLICE = 2 << 20

# Fixed value: the commonest characters of European prose, commonest first.
COMMON = b" etaonisrhldcumfpgwybv.,k\nxjqz"


def _companding() -> tuple[np.ndarray, np.ndarray]:
    """(sample of each byte, byte of each sample as unsigned): bytes by rank, those of COMMON first, lie about 0, -1, 1, -2, ... so that
    common ones have short Rice codes. One to one, so nothing is lost."""
    ranked = np.array([*COMMON, *(b for b in range(256) if b not in COMMON)])
    rank = np.arange(256)
    sample = np.zeros(256, np.int8)
    sample[ranked] = np.where(rank % 2 == 0, rank // 2, -(rank + 1) // 2)
    back = np.zeros(256, np.uint8)
    back[sample.view(np.uint8)] = np.arange(256)
    return sample, back


SAMPLE_OF, BYTE_OF = _companding()


def samples_of(data: np.ndarray) -> np.ndarray:
    """Bytes as signed samples, in the offset form that the encoder takes."""
    return (SAMPLE_OF[data].astype(np.int16) + 128).astype(np.uint8)


def payload_of(pcm: np.ndarray) -> np.ndarray:
    """The bytes that signed samples stand for."""
    return BYTE_OF[pcm.view(np.uint8)]


def padded(data: np.ndarray, offs: np.ndarray, unit: int = flac.BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Texts with blanks (byte 32) up to a positive multiple of `unit`: (bytes, length of each)."""
    lens = np.diff(offs)
    full = np.maximum(unit, -(-lens // unit) * unit)
    out = np.full(int(full.sum()), 32, np.uint8)
    shift = np.cumsum(full) - full - offs[:-1]
    out[np.repeat(shift, lens) + np.arange(len(data))] = data
    return out, full


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a FLAC stream."""

    def run(batches):
        for b in slices(batches, limit=MEDIA_SLICE):
            data, offs = text_buffers(b.column("text"))
            full, lens = padded(data, offs)
            streams = flac.encode_streams(samples_of(full), lens)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offs)), pa.array(streams, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, blocks: int = 16) -> DataFrame:
    """(doc_id, sample_offset, n_samples, pcm) and, on a stream's first row, n_bytes, media_bytes and media_sha256: each stream, decoded and
    held against its checksums, as runs of `blocks` FLAC blocks of signed 8-bit PCM, in order in one partition."""
    size = blocks * flac.BLOCK
    schema = "doc_id long, sample_offset long, n_samples long, pcm binary, n_bytes long, media_bytes long, media_sha256 string"

    def run(batches):
        for b in slices(batches, "media", MEDIA_SLICE):
            streams, ids, n_bytes = (b.column(c).to_pylist() for c in ("media", "doc_id", "n_bytes"))
            out = {c: [] for c in ("doc_id", "sample_offset", "n_samples", "pcm", "n_bytes", "media_bytes", "media_sha256")}
            for i, n, s, x in zip(ids, n_bytes, streams, flac.decode_streams(streams), strict=True):
                for at in range(0, len(x), size):
                    part = x[at : at + size]
                    row = (i, at, len(part), part.tobytes(), *((None, None, None) if at else (n, len(s), hashlib.sha256(s).hexdigest())))
                    for c, v in zip(out.values(), row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


class _Signal:
    """What is known of a stream from its blocks so far; memory does not grow with it."""

    def __init__(self, doc_id, n_bytes, media_bytes, media_sha256):
        self.told = (doc_id, n_bytes, media_bytes, media_sha256)
        self.sha, self.n, self.peak, self.squares, self.turns, self.last, self.tail = hashlib.sha256(), 0, 0, 0, 0, None, b""

    def add(self, at: int, pcm: bytes) -> None:
        if at != self.n:
            raise ValueError(f"a block of samples at {at} follows {self.n}")
        x = np.frombuffer(pcm, np.int8)
        payload = payload_of(x).tobytes()
        x = x.astype(np.int32)
        self.sha.update(payload)
        self.tail = (self.tail + payload)[-16:]
        self.peak = max(self.peak, int(np.abs(x).max(initial=0)))
        self.squares += int((x.astype(np.int64) ** 2).sum())
        below = x < 0
        self.turns += int((below[1:] != below[:-1]).sum()) + (self.last is not None and len(x) > 0 and bool(below[0]) != self.last)
        self.last = bool(below[-1]) if len(x) else self.last
        self.n += len(x)

    def row(self) -> tuple:
        doc_id, n_bytes, media_bytes, sha = self.told
        feature = f"rate={flac.RATE};blocks={self.n // flac.BLOCK};peak={self.peak};rms={(self.squares / max(1, self.n)) ** 0.5:.4f};crossings={self.turns}"
        return doc_id, n_bytes, self.n, self.sha.hexdigest(), crc(self.tail), media_bytes, sha, feature


def media_features(blocks: DataFrame) -> DataFrame:
    """Payload and signal of each stream, from its PCM blocks as pcm_blocks gives them."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        own = None
        for b in batches:
            rows = []
            for doc_id, at, pcm, n_bytes, media_bytes, sha in zip(*(b.column(c).to_pylist() for c in ("doc_id", "sample_offset", "pcm", "n_bytes", "media_bytes", "media_sha256")), strict=True):
                if at == 0:
                    if own:
                        rows.append(own.row())
                    own = _Signal(doc_id, n_bytes, media_bytes, sha)
                own.add(at, pcm)
            if rows:
                yield made(rows)
        if own:
            yield made([own.row()])
        tidy()

    return blocks.select("doc_id", "sample_offset", "pcm", "n_bytes", "media_bytes", "media_sha256").mapInArrow(run, schema)


def samples_at(stream: bytes, first: int, n: int) -> np.ndarray:
    """Samples first to first + n - 1 of a stream: from the last seek point before them on, nothing else is decoded."""
    return flac.decode_range(stream, first, n)


def op8_flac(spark, sf_dir: str) -> DataFrame:
    return media_features(pcm_blocks(store(encode_media(table(spark, sf_dir, "documents")), "media")))
