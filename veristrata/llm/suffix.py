"""Operator 9, suffix-array dedup over bytes.

The frame in superkmer brings all documents' 50-byte strings that can repeat together by shard. A shard is cut into parts;
each part gets a suffix array by Larsson-Sadakane refinement, common prefixes by Kasai's inequality, and the parts' sorted
strings are merged by binary search. Null texts are empty; texts under 50 bytes stay whole; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veristrata.llm.common import id_array, table
from veristrata.llm.substring import least_by_name
from veristrata.llm.superkmer import K, byte_units, mark_windows

#: Bytes of a part that gets one suffix array.
PART_BYTES = 3 << 20
#: Bytes by which suffixes are sorted: eight, doubled until a window is covered.
DEPTH = 64


def words_at(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, most significant first; zeros follow the end."""
    pad = np.append(x, np.zeros(8, np.uint8)).astype(np.uint64)
    n, out = len(x), pad[: len(x)].copy()
    for j in range(1, 8):
        out = (out << np.uint64(8)) | pad[j : j + n]
    return out


def suffix_array(key: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `depth` bytes at least, by Larsson-Sadakane: the ranks of h bytes, taken twice, sort by 2h; only
    groups that aren't single yet are sorted again. With them, which share `depth` bytes with the one before, and which not
    even half of them. key: words_at of the text."""
    n = len(key)
    sa = np.argsort(key).astype(np.int32)
    s = key[sa]
    new = np.append(True, s[1:] != s[:-1]) if n else np.zeros(0, bool)
    del s
    slot = np.arange(n, dtype=np.int32)
    rank = np.zeros(n + 1, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, slot, 0)) + 1
    open_ = ~(new & np.append(new[1:], True)) if n else new
    at, h, half = slot[open_], 8, rank
    while h < depth and len(at):
        half = rank.copy() if 2 * h >= depth else rank
        i = sa[at]
        k = rank[i].astype(np.int64) * (n + 2) + rank[np.minimum(i + h, n)]
        order = np.argsort(k)
        i, k = i[order], k[order]
        sa[at] = i
        new = np.append(True, k[1:] != k[:-1])
        rank[i] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    by, far = rank[sa], half[sa]
    return sa, np.append(False, by[1:] == by[:-1])[:n], np.append(True, far[1:] != far[:-1])[:n]


def common_prefixes(key: np.ndarray, sa: np.ndarray, tied: np.ndarray, apart: np.ndarray, most: int) -> np.ndarray:
    """Length, up to `most`, of the common prefix of each suffix in sa with the one before it. tied: those known to share `most`. apart: those
    whose length need not be known; it comes as 0.

    Kasai: what place p shares with its neighbour, place p + s shares but for s bytes. Places are taken in strides of 32,
    then the places halfway between, and so on, each starting from the place a stride before. That holds where the order of
    the two is settled within what was sorted, so places that share `most` bytes, the sorted depth, pass nothing on.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    wide = np.append(key, np.zeros(most + 8, np.uint64))
    lcp, known = np.zeros(n, np.int64), np.zeros(n, bool)
    lcp[sa[tied]] = most
    known[sa[tied | apart]] = True
    stride = 32
    todo = [(np.arange(0, n, stride), 0)]
    while stride > 1:
        todo.append((np.arange(stride // 2, n, stride), stride // 2))
        stride //= 2
    for p, back in todo:
        p = p[~known[p]]
        have = np.where(lcp[p - back] < most, np.maximum(lcp[p - back] - back, 0), 0) if back else np.zeros(len(p), np.int64)
        q = before[p]
        on = np.flatnonzero((q >= 0) & (have < most))
        have[q < 0] = 0
        while len(on):
            x = wide[p[on] + have[on]] ^ wide[q[on] + have[on]]
            same = x == 0
            part = on[~same]
            # whole bytes before the first that differs
            hi = (x[~same] >> np.uint64(32)).astype(np.float64)
            lo = (x[~same] & np.uint64(0xFFFFFFFF)).astype(np.float64)
            top = np.where(hi > 0, np.frexp(hi)[1] + 32, np.frexp(lo)[1])
            have[part] += (64 - top) >> 3
            on = on[same]
            have[on] += 8
            on = on[have[on] < most]
        lcp[p] = np.minimum(have, most)
    return lcp[sa]


def equal_byte_windows(strings: list[bytes], lo: np.ndarray, windows: np.ndarray) -> np.ndarray:
    lens = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    ends = np.cumsum(lens)
    cuts = np.searchsorted(ends, np.arange(PART_BYTES, int(ends[-1]) + PART_BYTES, PART_BYTES)) if len(ends) else []
    bounds = sorted({0, *(int(min(c + 1, len(strings))) for c in cuts), len(strings)})
    parts = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        x = np.frombuffer(b"\xff".join(strings[a:b]) + b"\xff", np.uint8) + np.uint8(1)  # bytes of UTF-8 become 1 to 245, ends 0
        base = ends[a:b] - lens[a:b] - (ends[a - 1] if a else 0)
        w = windows[a:b]
        at = np.repeat(base - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        key = words_at(x)
        sa, tied, apart = suffix_array(key)
        group = np.empty(len(x), np.int64)
        group[sa] = np.cumsum(common_prefixes(key, sa, tied, apart, DEPTH) < K)
        own = group[at]
        best = least_by_name(own, np.repeat(lo[a:b], w))
        if len(bounds) == 2:  # one part: nothing to merge
            return best
        order = np.argsort(own)
        new = np.append(True, own[order][1:] != own[order][:-1])
        first, back = order[new], np.empty(len(own), np.int64)
        back[order] = np.cumsum(new) - 1
        rows = x[at[first][:, None] + np.arange(K)]
        parts.append([np.ascontiguousarray(rows).view(f"S{K}").reshape(-1), best[first], back])
    if len(parts) > 1:  # sorted strings of each part, looked up in every other
        merged = [p[1].copy() for p in parts]
        for i, (mine, *_) in enumerate(parts):
            for j, (theirs, least, _) in enumerate(parts):
                if i != j and len(theirs):
                    k = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                    hit = theirs[k] == mine
                    merged[i][hit] = np.minimum(merged[i][hit], least[k[hit]])
        for p, m in zip(parts, merged, strict=True):
            p[1] = m
    return np.concatenate([p[1][p[2]] for p in parts]) if parts else np.zeros(0, np.int64)


def dedup_bytes(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with texts: kept as binary)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def finish(ids, data, offs, u, covered, rest):
        total = np.append(0, np.cumsum(covered))
        begin = covered.copy()
        begin[1:] &= ~covered[:-1]
        inner = offs[:-1][offs[:-1] < len(data)]
        begin[inner] = covered[inner]
        spans = np.append(0, np.cumsum(begin))
        left = np.ascontiguousarray(data[~covered]).tobytes()
        at = (offs - total[offs]).tolist()
        kept = [left[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        out = {"doc_id": id_array(ids), "n_bytes": pa.array(np.diff(offs), pa.int64()), "n_removed": pa.array(np.diff(total[offs]), pa.int64()), "n_spans": pa.array(np.diff(spans[offs]), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if texts:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    return mark_windows(docs, byte_units, equal_byte_windows, finish, schema, "bytes")


def op9_suffix(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"), texts=False)


OP9_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (
  SELECT doc_id, i, substring(x, CAST(2 * i + 1 AS INT), 100) AS win
  FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) // 2 - 49 AS BIGINT))) AS i FROM h WHERE length(x) >= 100)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM s),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM m WHERE lo < doc_id),
r AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c),
q AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, k),
g AS (SELECT doc_id, sum(z - a) AS n, count(*) AS spans FROM q GROUP BY doc_id),
e AS (
  SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY k) AS z FROM q
  UNION ALL SELECT doc_id, 0, min(a) FROM q GROUP BY doc_id),
t AS (
  SELECT h.doc_id, string_agg(substring(x, CAST(2 * a + 1 AS INT), CAST(2 * (coalesce(z, length(x) // 2) - a) AS INT)), '' ORDER BY a) AS kept
  FROM e JOIN h USING (doc_id) GROUP BY h.doc_id)
SELECT h.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(g.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(t.kept, h.x))) AS kept_sha256
FROM h LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)
"""
