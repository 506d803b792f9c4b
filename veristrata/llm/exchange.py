"""Which keys do several documents have? Packed rows ask buckets; buckets answer with a level for each key.

A packed row sends each of its distinct keys once, as a hash whose bits grow with the input, sorted and delta-coded by
bucket. The answer lies in the order of the question, a byte a key, compressed. A chance equality of hashes can only make
a key look shared, so callers use the answer to prune or to order, never as a result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veristrata.llm.common import mix, squeeze, store, stretch, tidy, unpack

BUCKET_BYTES, LEAST = 8 << 20, 24
U = np.uint64


def spread(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, distinct, first place of each) of a sort by key; equal input gives equal output."""
    order = np.argsort(keys)
    s = keys[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return order, s[first], first


class Exchange:
    """Buckets for a corpus of `total` bytes of text."""

    def __init__(self, total: int):
        self.buckets = int(max(LEAST, total // BUCKET_BYTES))
        self.bits = min(60, 10 + math.ceil(math.log2(total + 2)))
        self.width = -(-(1 << self.bits) // self.buckets)

    def question(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order by hash, hashes in that order, cuts by bucket)."""
        k = mix(keys * U(0xD6E8FEB86659FD93)) >> U(64 - self.bits)
        order = np.argsort(k)
        k = k[order]
        return order, k, np.searchsorted(k, np.arange(self.buckets + 1, dtype=U) * U(self.width))

    def levels(self, keys: np.ndarray, told: list[tuple[int, bytes]]) -> np.ndarray:
        """For each key: 0 if one document has it, else 1 + log2 of the packed rows that have it."""
        out = np.zeros(len(keys), np.uint8)
        if told:
            order, _, cut = self.question(keys)
            for p, x in told:
                out[order[cut[p] : cut[p + 1]]] = stretch(x, np.uint8)
        return out

    def shared(self, packed: DataFrame, keys_of: Callable, name: str) -> DataFrame:
        """Stored answers (src, bucket, heat). keys_of(ids, data, offs) gives distinct keys and whether several documents of the
        packed row have them."""
        width = self.width

        def ask(batches):
            for b in batches:
                for src, ids, lens, body in zip(*(b.column(c).to_pylist() for c in ("src", "ids", "lens", "body")), strict=True):
                    keys, several = keys_of(*unpack(ids, lens, body))
                    if not len(keys):
                        continue
                    order, k, cut = self.question(keys)
                    rows = []
                    for p in np.flatnonzero(np.diff(cut)).tolist():
                        own = slice(cut[p], cut[p + 1])
                        step = np.diff(k[own], prepend=U(p * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                        rows.append((p, src, len(step), squeeze(step.T), np.packbits(several[order[own]]).tobytes()))
                    cols = list(zip(*rows, strict=True))
                    tidy()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "src", "n", "keys", "several"])

        def answer(key, t):
            n = t.column("n").to_numpy()
            keys, several = [], []
            for m, x, s in zip(n.tolist(), t.column("keys").to_pylist(), t.column("several").to_pylist(), strict=True):
                step = np.zeros((m, 8), np.uint8)
                step[:, :5] = stretch(x, np.uint8).reshape(5, m).T
                keys.append(np.cumsum(step.view("<u8").reshape(-1)))
                several.append(np.unpackbits(np.frombuffer(s, np.uint8), count=m))
            keys, several = np.concatenate(keys), np.concatenate(several).astype(bool)
            order, _, first = spread(keys)
            count = np.diff(np.append(first, len(keys)))
            level = 1 + np.floor(np.log2(count)).astype(np.uint8)
            heat = np.empty(len(keys), np.uint8)
            heat[order] = np.repeat(np.where((count > 1) | np.logical_or.reduceat(several[order], first), level, 0), count)
            tidy()
            cut = np.append(0, np.cumsum(n))
            have = [r for r in range(len(n)) if heat[cut[r] : cut[r + 1]].any()]
            return pa.table({"src": pa.array(t.column("src").to_numpy()[have], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(have), pa.int32()), "heat": pa.array([squeeze(heat[cut[r] : cut[r + 1]]) for r in have], pa.binary())})

        asked = packed.select("src", "ids", "lens", "body").mapInArrow(ask, "bucket int, src long, n int, keys binary, several binary")
        return store(asked.groupBy("bucket").applyInArrow(answer, "src long, bucket int, heat binary"), name)


def answers_of(t) -> list[tuple[int, bytes]]:
    """The answers in the right side of a cogroup."""
    return [(p, x) for p, x in zip(t.column("bucket").to_pylist(), t.column("heat").to_pylist(), strict=True) if x is not None] if t.num_rows else []
