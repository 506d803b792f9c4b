"""Operator 5, substring dedup over words, by super-k-mer partitioning (the frame is in superkmer).

Each word covered by a window of 50 consecutive words that also starts in a document with a smaller id goes. Windows are
judged on the input. Null texts have no words; texts under 50 words stay whole; rows with equal ids don't judge each other.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veristrata.llm.common import Words, id_array, table
from veristrata.llm.superkmer import K, mark_windows, word_units


def least_by_name(names: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each place the smallest `least` among the places of the same name."""
    order = np.argsort(names)
    s = names[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    out = np.empty(len(names), np.int64)
    if len(s):
        out[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(s))))
    return out


def equal_word_windows(strings: list[bytes], lo: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sorts the windows of the strings exactly: runs of 1, 2, 4 ... 32 words get numbers by sorting pairs of numbers of their halves."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    w = Words(np.frombuffer(b"\n".join(strings) + b"\n", np.uint8), np.append(0, np.cumsum(lens)))
    name, size = w.codes.astype(np.int64), 1

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    while 2 * size <= K:
        name = joined(name[:-size], name[size:])
        size *= 2
    at = np.repeat(w.off[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    return least_by_name(joined(name[at], name[at + K - size]), np.repeat(lo, windows))


def dedup_words(docs: DataFrame, texts: bool = True, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, and with texts: kept), kept words joined by one blank.

    keep: other columns of docs to carry along; `kept` of a document that loses nothing is then its text as it was.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if texts:
        schema.add("kept", T.StringType())
    for c in keep or []:
        schema.add(c, docs.schema[c].dataType)

    def finish(ids, data, offs, u, covered, rest):
        raw, rows = data.tobytes(), []
        total = np.append(0, np.cumsum(covered))
        for a, b, i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), u.off[:-1].tolist(), u.off[1:].tolist(), strict=True):
            words, gone = raw[a:b].split(), int(total[j] - total[i])
            kept = b" ".join(compress(words, (~covered[i:j]).tolist()) if gone else words)
            rows.append((j - i, gone, hashlib.sha256(kept).hexdigest(), kept if gone or keep is None else raw[a:b]))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        out = {"doc_id": id_array(ids), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_sha256": pa.array(cols[2], pa.string())}
        if texts:
            out["kept"] = pa.array(cols[3], pa.binary()).cast(pa.string())
        if keep and not len(ids):
            return pa.table({c: pa.array([], to_arrow_type(f.dataType)) for c, f in zip(schema.names, schema.fields, strict=True)})
        for c, x in zip(keep or [], rest, strict=True):
            out[c] = x
        return pa.table(out)

    return mark_windows(docs, word_units, equal_word_windows, finish, schema, "words", keep)


def op5_substring(spark, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents"), texts=False)


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m WHERE lo < doc_id),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id),
k AS (
  SELECT w.doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) w
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.p = w.p)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)
"""
