"""Gzip files read by many tasks: an index of access points, made once by one pass over a file, then ranges decoded side by side.

An access point is the start of a deflate block (anywhere in a byte) or of a gzip member, with the place of its output and the
32 KB before it, which is all that decoding needs to begin there. Block starts are found near every SPAN bytes: bit patterns
that can begin a block with codes of its own are tried, and one counts only if what it decodes to, with the window, is what the
whole pass decodes. A file without such blocks (stored or fixed codes only) has one range, and is still read whole.

Records end with a separator; a range has the records that begin in it, so each is read once. Bytes that are not UTF-8 become
U+FFFD. A file that ends early or is damaged is an error.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.plans.checkpoint import store

SPAN = 16 << 20
CHUNK, AHEAD, HISTORY = 1 << 20, 256 << 10, 32 << 10
#: Bytes of output by which two decoders may differ that stop within the same byte: some symbols of up to 258 each.
SLACK = 2048


def _open(path: str):
    at, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return at.open_input_file(own)


def shifted(data: np.ndarray, bits: int) -> bytes:
    """The bytes from that many bits on; the last byte keeps what is left of it out."""
    if not bits:
        return data.tobytes()
    return ((data[:-1] >> np.uint8(bits)) | (data[1:] << np.uint8(8 - bits))).tobytes()


def block_starts(data: np.ndarray) -> np.ndarray:
    """Bit places where a block with codes of its own can begin: a header in range, and a complete code for its code lengths."""
    bits = np.unpackbits(data, bitorder="little").astype(np.int64)
    n = len(bits) - 17 - 3 * 19
    if n <= 0:
        return np.zeros(0, np.int64)
    field = lambda at, width: sum(bits[at + i] << i for i in range(width))
    p = np.flatnonzero((bits[:n] == 0) & (bits[1 : n + 1] == 0) & (bits[2 : n + 2] == 1))
    p = p[(field(p + 3, 5) <= 29) & (field(p + 8, 5) <= 29)]
    many = field(p + 13, 4) + 4
    kraft = np.zeros(len(p), np.int64)
    for i in range(19):
        length = field(p + 17 + 3 * i, 3)
        kraft += np.where((i < many) & (length > 0), 128 >> length, 0)
    return p[kraft == 128]


def _point(ahead: bytes, true: bytes, history: bytes) -> tuple[int, int, bytes] | None:
    """(bit, place in `true`, window) of the first block start in `ahead`, whose decoding, begun before it, gives `true` after `history`."""
    data, known = np.frombuffer(ahead, np.uint8), np.frombuffer(true, np.uint8)
    for bit in block_starts(data[: len(data) // 2]).tolist():
        stream = shifted(data[bit >> 3 :], bit & 7)
        try:
            d = zlib.decompressobj(-15, zdict=bytes(HISTORY))
            got = np.frombuffer(d.decompress(stream), np.uint8)
        except zlib.error:
            continue
        if d.eof or len(got) < 1024:
            continue
        literal = np.flatnonzero(got)  # what the missing window left out is nought
        for less in range(SLACK):
            place = len(known) - len(got) - less
            if place < 0:
                break
            if (known[place : place + len(got)][literal] == got[literal]).all():
                window = (history + true[:place])[-HISTORY:]
                whole = zlib.decompressobj(-15, zdict=window).decompress(stream)
                if whole == true[place : place + len(whole)]:
                    return bit, place, window
    return None


def access_points(path: str, span: int = SPAN):
    """(bit, output before it, window, next member's first byte or None) of a file, in order, by one pass."""
    with _open(path) as f:
        pos, out, history, d, next_at, points = 0, 0, b"", zlib.decompressobj(31), span, [[0, 0, b"", None]]
        rest, fresh, step = b"", True, min(CHUNK, span)  # fresh: nothing of a member has been read yet
        while True:
            data = rest or f.read(step)
            rest = b""
            if not data:
                if not d.eof and not fresh:
                    raise EOFError(f"{path} ends within a member")
                break
            look = pos >= next_at and not fresh and not d.eof
            if look and len(data) < AHEAD:
                data += f.read(AHEAD - len(data))
            if look:
                data, rest = data[:AHEAD], data[AHEAD:]
            made = d.decompress(data)
            fresh = False
            if look and not d.eof and (found := _point(data, made, history)):
                bit, place, window = found
                points.append([8 * pos + bit, out + place, window, None])
                next_at = pos + span
            out += len(made)
            history = (history + made)[-HISTORY:]
            pos += len(data)
            if d.eof:
                rest, pos = d.unused_data + rest, pos - len(d.unused_data)
                if not rest:
                    rest = f.read(CHUNK)
                if not rest or not rest.strip(b"\0"):  # nothing, or padding
                    break
                for p in points:
                    if p[3] is None:
                        p[3] = pos
                if pos >= next_at:
                    points.append([8 * pos, out, b"", None])
                    next_at, history = pos + span, history
                d, fresh = zlib.decompressobj(31), True
    return points, out


def gzip_index(spark: SparkSession, paths: list[str], span: int = SPAN) -> DataFrame:
    """Stored: (path, k, bit, out, next_out, window, member): the ranges of each file. Files are passed over side by side."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                points, total = access_points(path, span)
                for i, (bit, out, window, member) in enumerate(points):
                    after = points[i + 1][1] if i + 1 < len(points) else total
                    values = [pa.array([path], pa.string()), *(pa.array([x], pa.int64()) for x in (i, bit, out, after)), pa.array([window], pa.binary()), pa.array([member], pa.int64())]
                    yield pa.RecordBatch.from_arrays(values, ["path", "k", "bit", "out", "next_out", "window", "member"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return store(files.mapInArrow(run, "path string, k long, bit long, out long, next_out long, window binary, member long"), "gzip-index")


def _output(path: str, bit: int, window: bytes, member: int | None):
    """The output from an access point to the end of the file, chunk by chunk."""
    with _open(path) as f:
        f.seek(bit >> 3)
        if window or bit & 7:
            d, carry = zlib.decompressobj(-15, zdict=window), np.zeros(0, np.uint8)
            while not d.eof:
                raw = f.read(CHUNK)
                if not raw:
                    raise EOFError(f"{path} ends within a member")
                data = np.concatenate([carry, np.frombuffer(raw, np.uint8)])
                carry = data[-1:] if bit & 7 else data[:0]
                yield d.decompress(shifted(data, bit & 7) if bit & 7 else raw)
                if not d.eof and bit & 7 and f.tell() == f.size():  # the last bits of the file
                    yield d.decompress(shifted(np.append(carry, np.uint8(0)), bit & 7))
            if member is None:
                return
            f.seek(member)
        rest = f.read(CHUNK)
        while rest and rest.strip(b"\0"):
            d = zlib.decompressobj(31)
            while not d.eof:
                if not rest and not (rest := f.read(CHUNK)):
                    raise EOFError(f"{path} ends within a member")
                yield d.decompress(rest)
                rest = b""
            rest = d.unused_data or f.read(CHUNK)


def records_of(path: str, bit: int, out: int, next_out: int, window: bytes, member: int | None, sep: bytes):
    """The records that begin after `out` (or at 0) and not after next_out."""
    lead = len(sep) - 1
    buffer, base = (window[-lead:] if lead and out else b""), out  # base: place of the buffer's first byte
    base -= len(buffer)
    begun = out == 0
    for piece in _output(path, bit, window, member):
        buffer += piece
        if not begun:
            at = buffer.find(sep)
            if at < 0:
                keep = max(0, len(buffer) - lead)
                base, buffer = base + keep, buffer[keep:]
                if base > next_out:
                    return
                continue
            base, buffer, begun = base + at + len(sep), buffer[at + len(sep) :], True
            if base > next_out:
                return
        *whole, buffer_ = buffer.split(sep)
        for w in whole:
            if base > next_out:
                return
            yield w
            base += len(w) + len(sep)
        buffer = buffer_
        if base > next_out:
            return
    if begun and buffer and base <= next_out:
        yield buffer


def gzip_records(spark: SparkSession, paths: list[str], sep: str = "\n", span: int = SPAN) -> DataFrame:
    """(_row_idx, value): the records of gzip files, a task a range; _row_idx (file, split, place) is their order."""
    index = gzip_index(spark, paths, span)
    ranges = max(1, index.count())

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                values, place = [], 0
                row = lambda v, n: pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(v), pa.string()), pa.array([r["k"]] * len(v), pa.int64()), pa.array(range(n, n + len(v)), pa.int64()), pa.array([x.decode("utf-8", "replace") for x in v], pa.string())], ["file", "split", "place", "value"])  # noqa: E731, B023
                size = 0
                for v in records_of(r["path"], r["bit"], r["out"], r["next_out"], r["window"], r["member"], sep.encode()):
                    values.append(v)
                    size += len(v)
                    if size > CHUNK or len(values) >= 10_000:
                        yield row(values, place)
                        place, values, size = place + len(values), [], 0
                if values:
                    yield row(values, place)

    got = index.repartition(ranges, "path", "k").mapInArrow(run, "file string, split long, place long, value string")
    return got.select(F.struct("file", "split", "place").alias("_row_idx"), "value")
