"""Operator 3, language ID by hierarchical discrimination.

A text becomes the shares of its hashed byte bigrams and trigrams (lower case; everything that isn't a letter is a blank).
Linear support vector machines, one against the rest, choose the language family; within it, one for each pair of languages
votes. They are fitted on every labelled text that is not held out, however many there are; a text that is repeated in a language
is one text of it. Up to LOCAL rows the driver fits them; more stay with Spark as stored blocks of n-gram counts, and each
round of the same descent (all machines side by side) is one sum over the blocks. A caller may ask for a bounded sample instead.
Prediction reads every whole text and nothing else.

`und` for a null text, a text without a letter, or where nothing was learned. Rows without lang teach nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import discard, doc_crc, in_own_session, slices, squeeze, store, stretch, table, text_buffers, tidy

DIMS = 4096
_BIGRAMS = 1024
#: Rows that the driver learns from by itself; of more, texts in a task, texts in a block, and numbers that are added up together.
LOCAL, TASK, BLOCK, SLICE = 3000, 8192, 64, 1 << 20
#: Weight of the machines' size; the descent ends at this part of its first gradient, or after so many sums.
PENALTY, CLOSE, SUMS = 1e-4, 1e-3, 80
#: Range of the hash that tells texts apart.
HASHES = 1 << 60
UNKNOWN = "und"

# Families of languages by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tk", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def ngrams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, DIMS): how often each hashed n-gram is in the text."""
    n = len(offs) - 1
    x = _FOLD[data]
    doc = np.repeat(np.arange(n), np.diff(offs))
    out = np.zeros(n * DIMS)
    if len(x) > 1:
        two = (x[:-1] << 8) | x[1:]
        ok = doc[:-1] == doc[1:]
        out += np.bincount((doc[:-1] * DIMS + ((two * 40503) >> 4) % _BIGRAMS)[ok], minlength=n * DIMS)
    if len(x) > 2:
        three = (two[:-1] << 8) | x[2:]
        ok = doc[:-2] == doc[2:]
        out += np.bincount((doc[:-2] * DIMS + _BIGRAMS + ((three * 2654435761) >> 13) % (DIMS - _BIGRAMS))[ok], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def shares_of(counts: np.ndarray) -> np.ndarray:
    """Counts as shares of their row, float32."""
    x = counts.astype(np.float32)
    x /= np.maximum(counts.sum(1, keepdims=True, dtype=np.int64), 1)  # in place: a new array for each block costs more than the sums
    return x


def shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, DIMS) float32: the share of each hashed n-gram in the text."""
    return shares_of(ngrams(data, offs))


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    weights: np.ndarray  # DIMS + 1 rows; a column a family, then a column a pair
    pairs: list[tuple[int, int]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, confidence from 0 to 1) of each row of shares."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        sure = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -15, 15)))
        f = len(self.families)
        fam = margin[:, :f].argmax(1)
        score = sure(margin[np.arange(len(x)), fam]) if f > 1 else np.ones(len(x))
        of = np.array([self.families.index(family_of(c)) for c in self.langs])
        votes = np.zeros((len(x), len(self.langs)))
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, f + k]
            votes[:, a] += (m >= 0) + 1e-3 * sure(m)
            votes[:, b] += (m < 0) + 1e-3 * sure(-m)
        votes[of[None, :] != fam[:, None]] = -1
        best = votes.argmax(1)
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, f + k]
            score = np.where(best == a, np.minimum(score, sure(m)), np.where(best == b, np.minimum(score, sure(-m)), score))
        return best, score


def _sizes(lang: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the shares, then texts of each of n languages."""
    return np.append(x.sum(0, dtype=np.float64), np.bincount(lang, minlength=n))


def _losses(lang: np.ndarray, x: np.ndarray, w: np.ndarray, sign: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared hinge losses of the machines (columns of w) on these texts, above their gradients. sign, weight: of each language in each machine."""
    side = sign[lang]
    slack = np.maximum(0, 1 - side * (x @ w[:-1] + w[-1])) * (side != 0)
    pull = 2 * weight[lang] * side * slack
    return np.vstack([(weight[lang] * slack**2).sum(0, dtype=np.float64), -(x.T @ pull), -pull.sum(0)])


def _descend(value: Callable, w: np.ndarray) -> np.ndarray:
    """Columns that each minimise their own function by L-BFGS. value(w): (values, gradients) of all columns."""
    f, g = value(w)
    first, steps, sums = np.linalg.norm(g, axis=0), [], 1
    while sums < SUMS and (np.linalg.norm(g, axis=0) > CLOSE * first).any():
        way, back = g.copy(), []
        for s, y, r in reversed(steps):
            back.append(r * (s * way).sum(0))
            way -= back[-1] * y
        if steps:
            s, y, _ = steps[-1]
            way *= np.where((y * y).sum(0) > 0, (s * y).sum(0) / np.maximum((y * y).sum(0), 1e-300), 1)
        else:
            way /= np.maximum(first, 1e-12)
        for (s, y, r), a in zip(steps, reversed(back), strict=True):
            way += s * (a - r * (y * way).sum(0))
        slope, t = -(way * g).sum(0), np.ones(w.shape[1])
        while True:
            lower, there = value(w - t * way)
            sums += 1
            far = lower > f + 1e-4 * t * slope
            if not far.any() or sums >= SUMS:
                break
            t = np.where(far, np.clip(-slope * t * t / np.maximum(2 * (lower - f - slope * t), 1e-300), 0.1 * t, 0.5 * t), t)
        t = np.where(far, 0, t)
        there, lower = np.where(far, g, there), np.where(far, f, lower)
        s, y = -t * way, there - g
        along = (s * y).sum(0)
        steps = [*steps, (s, y, np.where(along > 1e-12 * (y * y).sum(0), 1 / np.maximum(along, 1e-300), 0.0))][-10:]
        w, f, g = w + s, lower, there
    return w


def learn(langs: list[str], add: Callable) -> Model:
    """add(of): the sum of of(numbers of languages, shares) over all texts, some at a time."""
    families = sorted({family_of(c) for c in langs})
    of = np.array([families.index(family_of(c)) for c in langs])
    pairs = [(a, b) for a in range(len(langs)) for b in range(a + 1, len(langs)) if of[a] == of[b]]
    sign = np.zeros((len(langs), len(families) + len(pairs)), np.float32)  # a machine a column: 1 and -1 on its sides, 0 for others
    if len(families) > 1:
        sign[:, : len(families)] = np.where(of[:, None] == np.arange(len(families)), 1, -1)
    for k, (a, b) in enumerate(pairs, len(families)):
        sign[a, k], sign[b, k] = 1, -1
    sums = add(partial(_sizes, n=len(langs)))
    n = sums[DIMS:, None]
    weight = sum(0.5 * on / np.maximum(1, (on * n).sum(0)) for on in (sign > 0, sign < 0)).astype(np.float32)  # both sides weigh the same
    scale = np.append(1 / np.sqrt(sums[:DIMS] / n.sum() + 1e-5), 1.0)[:, None]

    def value(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = add(partial(_losses, w=(w * scale).astype(np.float32), sign=sign, weight=weight))
        return got[0] + PENALTY / 2 * (w * w).sum(0), got[1:] * scale + PENALTY * w

    w = _descend(value, np.zeros((DIMS + 1, sign.shape[1])))
    return Model(langs, families, (w * scale).astype(np.float32), pairs)


def fit(labels: list[str], x: np.ndarray) -> Model | None:
    """Learns from texts at hand."""
    langs = sorted(set(labels))
    if not langs:
        return None
    lang = np.array([langs.index(c) for c in labels])
    return learn(langs, lambda of: sum(of(lang[i : i + 1024], x[i : i + 1024]) for i in range(0, len(x), 1024)))


def fit_blocks(langs: list[str], blocks: DataFrame) -> Model:
    """Learns from stored blocks (lang, wide, x) of counts."""
    sc = blocks.sparkSession.sparkContext

    def add(of):
        shared = sc.broadcast(of)

        def run(batches):
            from pyspark import TaskContext

            acc = 0
            for b in batches:
                for lang, wide, x in zip(b.column("lang").to_pylist(), b.column("wide").to_pylist(), b.column("x").to_pylist(), strict=True):
                    acc = acc + shared.value(np.frombuffer(lang, np.int32), shares_of(stretch(x, f"u{wide}").reshape(-1, DIMS)))
            if isinstance(acc, np.ndarray):
                part = TaskContext.get().partitionId() % 8
                for k in range(0, acc.size, SLICE):
                    yield pa.RecordBatch.from_pydict({"k": [k], "part": [part], "of": [str(acc.shape)[1:-1]], "x": [acc.ravel()[k : k + SLICE].tobytes()]})

        def merge(batches):
            sums, shapes = {}, {}
            for b in batches:
                for k, shape, x in zip(b.column("k").to_pylist(), b.column("of").to_pylist(), b.column("x").to_pylist(), strict=True):
                    sums[k], shapes[k] = sums.get(k, 0) + np.frombuffer(x), shape
            for k, x in sums.items():
                yield pa.RecordBatch.from_pydict({"k": [k], "of": [shapes[k]], "x": [x.tobytes()]})

        parts = blocks.mapInArrow(run, "k long, part long, of string, x binary").repartition(8, "k", "part").select("k", "of", "x").mapInArrow(merge, "k long, of string, x binary").collect()  # 8 sums at most
        shared.destroy()
        shape = tuple(int(n) for n in parts[0]["of"].split(",") if n.strip())
        total = np.zeros(math.prod(shape))
        for r in parts:
            total[r.k : r.k + SLICE] += np.frombuffer(r.x)
        return total.reshape(shape)

    return learn(langs, add)


def train_language_model(docs: DataFrame, held_out=None, sample: int | None = None, total: int | None = None) -> Model | None:
    """held_out: a Column that is true for texts that must not be learned from (null is not held out).
    sample, total: learn from so many different texts a language, and in all, only; otherwise from all."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out is not None:
        usable = usable.where(~F.coalesce(held_out, F.lit(False)))
    letters = F.col("text").cast("string").rlike(r"\p{L}")
    at = F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(HASHES))  # of the text alone: copies are one text
    usable = in_own_session(usable.select(F.col("lang").cast("string").alias("lang"), at.alias("at"), F.col("text").cast("string").alias("text")).where(letters))
    bounded = sample is not None or total is not None
    number = F.approx_count_distinct("at", 0.02) if bounded else F.count("at")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(number.alias("n")).collect()}  # one row a language
    if not counts:
        return None
    langs = sorted(counts)
    if bounded:
        each = max(1, min(sample or HASHES, (total or HASHES) // len(counts)))
        limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(HASHES, int(HASHES * (1.2 * each + 5 * each**0.5 + 20) / n)))])
        usable = usable.where(F.col("at") < limit[F.col("lang")])  # about `each` hashes a language pass the limit

    def run(batches):
        seen = set()  # a text that very many rows have is looked at once a task
        for b in slices(batches):
            keys = list(zip(b.column("lang").to_pylist(), b.column("at").to_pylist(), strict=True))
            first = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            for k in range(0, len(first), 256):
                own = b.take(pa.array(first[k : k + 256]))
                x = ngrams(*text_buffers(own.column("text"))).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([own.column("lang"), own.column("at"), pa.array([squeeze(r) for r in x], pa.binary())], ["lang", "at", "x"])

    rows = usable.mapInArrow(run, "lang string, at long, x binary")
    if not bounded and sum(counts.values()) > LOCAL:
        parts = math.ceil(sum(counts.values()) / TASK)
        rows.sparkSession.conf.set("spark.sql.files.minPartitionNum", str(parts))
        different = rows.repartition(parts, "lang", "at").groupBy("lang", "at").agg(F.min("x").alias("x"))
        blocks = store(different.select("lang", "x").mapInArrow(partial(_blocks, langs=langs), "lang binary, wide int, x binary"), "language-blocks")
        model = fit_blocks(langs, blocks)
        discard(blocks)
        return model
    chosen = rows.groupBy("lang", "at").agg(F.min("x").alias("x"))
    if bounded:
        chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).where(F.col("k") <= each)
    labels, x = [], []
    for r in sorted(chosen.select("lang", "at", "x").collect(), key=lambda r: (r.lang, r.at)):  # LOCAL or `total` rows at most
        labels.append(r.lang)
        x.append(stretch(r.x, np.uint32))
    model = fit(labels, shares_of(np.stack(x))) if x else None
    del x
    tidy()
    return model


def _blocks(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts' languages and counts, BLOCK texts a row, in the narrowest type that holds them."""
    number, lang, x = {c: i for i, c in enumerate(langs)}, [], []

    def block():
        counts = np.stack(x)
        wide = np.min_scalar_type(counts.max()).itemsize
        return pa.RecordBatch.from_arrays([pa.array([np.array(lang, np.int32).tobytes()], pa.binary()), pa.array([wide], pa.int32()), pa.array([squeeze(counts.astype(f"u{wide}"))], pa.binary())], ["lang", "wide", "x"])

    for b in batches:
        for c, row in zip(b.column("lang").to_pylist(), b.column("x").to_pylist(), strict=True):
            lang.append(number[c])
            x.append(stretch(row, np.uint32))
            if len(x) == BLOCK:
                yield block()
                lang, x = [], []
    if x:
        yield block()


def predict_languages(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score, computed from text alone. Other columns' names don't matter."""
    names = docs.columns if keep is None else keep
    text = F.col("text").cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    row_type = own.schema["row"].dataType

    def run(batches):
        for b in slices(batches):
            letters = b.column("letters").to_numpy(zero_copy_only=False)
            if model is None:
                lang, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            else:
                data, offs = text_buffers(b.column("text"))
                done = [model.predict(shares(data[offs[i] : offs[min(i + 256, b.num_rows)]], offs[i : i + 257] - offs[i])) for i in range(0, b.num_rows, 256)]
                lang, score = (np.concatenate(a) for a in zip(*done, strict=True))
            known = letters & (model is not None)
            said = [model.langs[k] if ok else UNKNOWN for k, ok in zip(lang, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0).astype(np.float64))], ["row", "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("row", row_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    done = own.mapInArrow(run, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in names], "lang_pred", "score")


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(doc_crc(), F.lit(3)) == 1
    model = train_language_model(docs, held)

    texts = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return predict_languages(texts, model, keep=["doc_id", "held_out"])
