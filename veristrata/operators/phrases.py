"""Many phrases, or a pattern, in one scan of the texts, with places and contexts (G13, G14, 2.8).

Each task makes one automaton of all phrases and reads its texts once, however many phrases there are. Occurrences of a phrase
do not overlap each other (as of a regex search for it alone), those of different phrases may. A context is cut out of the
whole text, so it runs over neighbouring occurrences. Null and empty texts hold nothing; empty and repeated phrases are
left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of phrases that a task holds; more than this is data, not a list of phrases.
MOST_BYTES = 64 << 20


def lowered(text: str) -> str:
    """Lower case without a change of places: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _kept(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, list[T.StructField]]:
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(1).alias("_")]).alias("row"), F.col(text).cast("string").alias("text"))
    return own.where("text IS NOT NULL AND text <> ''"), [T.StructField("row", own.schema["row"].dataType)]


def _result(found: DataFrame, keep: list[str]) -> DataFrame:
    return found.select(*[F.col("row").getField(c).alias(c) for c in keep], *[c for c in found.columns if c != "row"])


def find_phrases(texts: DataFrame, phrases: list[str], text: str = "text", keep: list[str] | None = None, ignore_case: bool = True, before: int = 0, after: int = 0) -> DataFrame:
    """(keep..., phrase, at, context): each occurrence, its 0-based place, and up to `before` and `after` characters around it."""
    wanted = sorted({p for p in phrases if p})
    if sum(len(p.encode()) for p in wanted) > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes of phrases")
    own, fields = _kept(texts, keep or [], text)
    schema = T.StructType([*fields, T.StructField("phrase", T.StringType()), T.StructField("at", T.LongType()), T.StructField("context", T.StringType())])
    if not wanted:
        return _result(own.sparkSession.createDataFrame([], schema), keep or [])
    shared = own.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        import ahocorasick

        words = shared.value
        by_key: dict[str, list[int]] = {}
        for i, p in enumerate(words):
            by_key.setdefault(lowered(p) if ignore_case else p, []).append(i)
        automaton = ahocorasick.Automaton()
        for key, who in by_key.items():
            automaton.add_word(key, (len(key), who))
        automaton.make_automaton()
        for b in batches:
            rows, names, places, contexts = [], [], [], []
            for r, t in enumerate(b.column("text").to_pylist()):
                ends: dict[int, int] = {}  # where the last occurrence of a phrase ended
                for last, (n, who) in automaton.iter(lowered(t) if ignore_case else t):
                    start = last + 1 - n
                    for i in who:
                        if start >= ends.get(i, 0):
                            ends[i] = last + 1
                            rows.append(r)
                            names.append(words[i])
                            places.append(start)
                            contexts.append(t[max(0, start - before) : last + 1 + after])
                if len(rows) > 20_000:
                    yield _found(b, rows, [pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(contexts, pa.string())], ["phrase", "at", "context"])
                    rows, names, places, contexts = [], [], [], []
            if rows:
                yield _found(b, rows, [pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(contexts, pa.string())], ["phrase", "at", "context"])

    return _result(own.mapInArrow(run, schema), keep or [])


def _found(b: pa.RecordBatch, rows: list[int], columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("row").take(pa.array(rows)), *columns], ["row", *names])


def find_pattern(texts: DataFrame, pattern: str, text: str = "text", keep: list[str] | None = None, ignore_case: bool = False, before: int = 0, after: int = 0, most: int | None = None) -> DataFrame:
    """2.8: (keep..., match, at, context): every match of a Python pattern, or the first `most` of each text."""
    re.compile(pattern)
    own, fields = _kept(texts, keep or [], text)
    schema = T.StructType([*fields, T.StructField("match", T.StringType()), T.StructField("at", T.LongType()), T.StructField("context", T.StringType())])

    def run(batches):
        search = re.compile(pattern, re.I if ignore_case else 0)
        for b in batches:
            rows, out = [], ([], [], [])
            for r, t in enumerate(b.column("text").to_pylist()):
                for k, m in enumerate(search.finditer(t)):
                    if most is not None and k >= most:
                        break
                    rows.append(r)
                    for column, v in zip(out, (m.group(), m.start(), t[max(0, m.start() - before) : m.end() + after]), strict=True):
                        column.append(v)
            if rows:
                yield _found(b, rows, [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["match", "at", "context"])

    return _result(own.mapInArrow(run, schema), keep or [])
