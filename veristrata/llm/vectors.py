"""Vector code compression: product quantisation by integer Lloyd rounds with Elkan's triangle-inequality pruning.

Blocks of vectors travel from round to round as stored rows with, for each part, its assigned entry, one upper bound on the
distance to it, and one lower bound for each entry. A round first shifts the bounds by the entries' movement; distances are
computed only where no strict inequality rules an entry out, in integers, so ties are decided exactly and every result equals
that of plain Lloyd rounds. Bounds are single floats rounded outwards, which keeps every inequality valid.

Nulls and ties: vectors that are null or hold a null, NaN or infinite component are dropped. A null id sorts last; of equal
ids the smaller vector comes first. Equal distances go to the lower entry. A vector whose length differs from that of the
smallest id's has no code and no errors (null). Lengths that 8 does not divide are padded with zeros; an empty vector has
the code 00..00 and the error 0. Fewer kept vectors than entries make as many entries. Components of any finite size are exact
(Python integers where 64 bits don't suffice); an error beyond 2^63-1 is given as 2^63-1. Other columns are ignored. An empty
table has an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import discard, squeeze, store, stretch, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers below this have exact squared distances and sums of a block in 64 bits, up to 2^9 components a part.
SAFE = 1 << 26
LONGEST = (1 << 63) - 1
LIMB = 32


def to_integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64, or Python integers if some are large."""
    if x.size == 0 or np.abs(x).max() < SAFE / SCALE:
        return np.floor(x.astype(np.float64) * SCALE).astype(np.int64)
    exact = lambda v: int(v) * SCALE if abs(v) >= 1 << 60 else math.floor(v * SCALE)
    return np.array([exact(float(v)) for v in x.ravel()], object).reshape(x.shape)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one entry (or row by row), exact."""
    d = x - c
    return (d * d).sum(1) if d.shape[1] else np.zeros(len(d), np.int64)


def _root(d2) -> np.ndarray:
    a = np.asarray(d2)
    if a.dtype == object:
        a = np.array([min(float(min(v, 10**300)), 1e300) for v in a.ravel()]).reshape(a.shape)
    return np.sqrt(a.astype(np.float64))


def _up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    most = np.finfo(np.float32).max
    return np.maximum(np.nextafter(np.minimum(x * (1 - 1e-12), most).astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Part:
    """Bounds and entries of one part of a block's vectors."""

    def __init__(self, x: np.ndarray, a: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
        self.x, self.a, self.upper, self.lower = x, a, upper, lower
        self.distances = 0

    def shift(self, moves: np.ndarray) -> None:
        """Entries have moved by at most `moves`."""
        self.upper = _up(self.upper.astype(np.float64) + moves[self.a])
        self.lower = _down(np.maximum(self.lower.astype(np.float64) - moves, 0))

    def assign(self, c: np.ndarray) -> None:
        x, n, k = self.x, len(self.x), len(c)
        big = LONGEST if x.dtype != object and c.dtype != object else 1 << 5000
        if self.a is None:
            d2 = np.stack([_squares(x, c[j]) for j in range(k)], 1) if n else np.zeros((0, k), np.int64)
            self.a = d2.argmin(1)
            self.lower = _down(_root(d2))
            self.upper = _up(_root(d2[np.arange(n), self.a]))
            self.distances += d2.size
            return
        half = _down(0.5 * _root(np.stack([_squares(c, c[j]) for j in range(k)], 1)))
        np.fill_diagonal(half, np.inf)
        at = np.flatnonzero(~(half.min(1)[self.a] > self.upper))
        if not len(at):
            return
        own = self.a[at]
        best = np.full((len(at), k), big, object if big > LONGEST else np.int64)
        d2 = _squares(x[at], c[own])
        best[np.arange(len(at)), own] = d2
        upper = _up(_root(d2))
        self.lower[at, own] = _down(_root(d2))
        self.distances += len(at)
        left = ~(self.lower[at] > upper[:, None]) & ~(half[own] > upper[:, None])
        left[np.arange(len(at)), own] = False
        for j in np.flatnonzero(left.any(0)):
            i = np.flatnonzero(left[:, j])
            best[i, j] = d2 = _squares(x[at[i]], c[j])
            self.lower[at[i], j] = _down(_root(d2))
            self.distances += len(i)
        self.a[at] = best.argmin(1)  # the lowest of equal ones
        self.upper[at] = _up(_root(best[np.arange(len(at)), self.a[at]]))

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, sums of components) of each entry."""
        n = np.bincount(self.a, minlength=k)
        if self.x.dtype == object:
            return n, np.array([[sum(col) for col in self.x[self.a == j].T] if n[j] else [0] * self.x.shape[1] for j in range(k)], object).reshape(k, -1)
        one = (self.a == np.arange(k)[:, None]).astype(np.float64)
        return n, np.rint(one @ self.x.astype(np.float64)).astype(np.int64)  # exact: below 2^53 for blocks of up to 2^27 rows


def _limbs(v: int):
    """v as sum of limb * 2^(32 place): sums of limbs fit 64 bits for any number of blocks."""
    place = 0
    while v:
        low = v & ((1 << LIMB) - 1) if v >= 1 << LIMB or v < -(1 << LIMB) else v
        yield place, low
        v, place = (v - low) >> LIMB, place + 1


def _pieces(x: np.ndarray, parts: int) -> list[np.ndarray]:
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1])))
    return [to_integers(x[:, p * width : (p + 1) * width]) for p in range(parts)]


SUMS = "array<struct<cell: int, place: int, v: bigint>>"
BLOCK = f"ids array<bigint>, labels array<bigint>, n int, dim int, x binary, wide boolean, a binary, upper binary, lower binary, sums {SUMS}"


def _raw(b: pa.RecordBatch, dim: int) -> np.ndarray:
    col = b.column("vector")
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim) if b.num_rows else np.zeros((0, dim))
    narrow = x.astype(np.float32)
    return narrow if (narrow == x).all() else x


def _block(b: pa.RecordBatch, ids, labels, x: np.ndarray, done: list[Part], k: int) -> pa.RecordBatch:
    cells, width = [], done[0].x.shape[1]
    for p, part in enumerate(done):
        n, s = part.sums(k)
        for j in range(k):
            first = (p * k + j) * (width + 1)
            cells += [{"cell": first + q, "place": place, "v": v} for q, total in enumerate([n[j], *s[j]]) for place, v in _limbs(int(total))]
    values = {
        "ids": pa.array([ids], pa.list_(pa.int64())), "labels": pa.array([labels], pa.list_(pa.int64())), "n": pa.array([len(x)], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "x": pa.array([squeeze(x)], pa.binary()), "wide": pa.array([x.dtype == np.float64]),
        "a": pa.array([squeeze(np.stack([q.a for q in done]).astype(np.uint8))], pa.binary()), "upper": pa.array([squeeze(np.stack([q.upper for q in done]))], pa.binary()), "lower": pa.array([squeeze(np.stack([q.lower for q in done]))], pa.binary()),
        "sums": pa.array([cells], pa.list_(pa.struct([("cell", pa.int32()), ("place", pa.int32()), ("v", pa.int64())]))),
    }
    return pa.RecordBatch.from_pydict(values)


def _first_round(books: list[np.ndarray], dim: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _raw(b, dim)
                done = [Part(v) for v in _pieces(x, len(books))]
                for part, c in zip(done, books, strict=True):
                    part.assign(c)
                yield _block(b, b.column("vec_id").to_pylist(), b.column("label").to_pylist(), x, done, len(books[0]))

    return run


def _loaded(b: pa.RecordBatch, r: int, books: list[np.ndarray], moves: list[np.ndarray]):
    """Row r of a batch of blocks, moved and assigned anew."""
    get = lambda c: b.column(c)[r].as_py()
    n, dim, parts, k = get("n"), get("dim"), len(books), len(books[0])
    x = stretch(get("x"), np.float64 if get("wide") else np.float32).reshape(n, dim)
    a = stretch(get("a"), np.uint8).reshape(parts, n).astype(np.int64)
    upper, lower = stretch(get("upper"), np.float32).reshape(parts, n), stretch(get("lower"), np.float32).reshape(parts, n, k)
    done = [Part(v, a[p].copy(), upper[p].copy(), lower[p].copy()) for p, v in enumerate(_pieces(x, parts))]
    for part, c, m in zip(done, books, moves, strict=True):
        part.shift(m)
        part.assign(c)
    return x, done


def _next_round(books, moves):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x, done = _loaded(b, r, books, moves)
                yield _block(b, b.column("ids")[r].as_py(), b.column("labels")[r].as_py(), x, done, len(books[0]))

    return run


def _last_round(books, moves):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                _, done = _loaded(b, r, books, moves)
                error = sum(_squares(q.x, c[q.a]) for q, c in zip(done, books, strict=True))
                codes = np.stack([q.a for q in done], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[r].values, b.column("labels")[r].values, pa.array([v.tobytes().hex() for v in codes], pa.string()), pa.array([min(int(v), LONGEST) for v in error], pa.int64())], ["vec_id", "label", "code", "error"]
                )

    return run


def _as_entries(v: np.ndarray) -> np.ndarray:
    """int64 where distances stay exact in 64 bits, else Python integers."""
    small = v.size == 0 or max(abs(int(q)) for q in v.ravel()) < SAFE
    return v.astype(np.int64) if small else v.astype(object)


def _renewed(blocks: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(entries after an update, how far each has moved at most)."""
    k, width = books[0].shape
    total = [0] * (len(books) * k * (width + 1))
    # a number for each component of each entry, whatever the rows
    for r in blocks.select(F.explode("sums").alias("s")).select("s.*").groupBy("cell", "place").agg(F.sum("v").alias("v")).collect():
        total[r.cell] += r.v << (LIMB * r.place)
    new, moves = [], []
    for p, c in enumerate(books):
        rows = []
        for j in range(k):
            n, *s = total[(p * k + j) * (width + 1) : (p * k + j + 1) * (width + 1)]
            rows.append([v // n for v in s] if n else [int(v) for v in c[j]])
        own = _as_entries(np.array(rows, object).reshape(k, width))
        new.append(own)
        moves.append(_up(_root(_squares(own.astype(object), c.astype(object)))).astype(np.float64))
    return new, moves


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (doubles) of the rows without null and non-finite components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("vector"))


def quantise(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the kept rows, and the codebooks."""
    kept = kept_vectors(vectors)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries * 4).collect()
    schema = "vec_id long, label long, code string, error long"
    if not first:
        return kept.sparkSession.createDataFrame([], schema), []
    dim = len(first[0].vector)
    own = kept.where(F.size("vector") == dim)
    if any(len(r.vector) != dim for r in first):
        first = own.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    start = np.array([r.vector for r in first[:entries]], np.float64).reshape(len(first[:entries]), dim)
    books = [_as_entries(v) for v in _pieces(start, parts)]
    blocks = store(own.mapInArrow(_first_round(books, dim), BLOCK), "vectors")
    books, moves = _renewed(blocks, books)
    for _ in range(rounds - 1):
        old, blocks = blocks, store(blocks.drop("sums").mapInArrow(_next_round(books, moves), BLOCK), "vectors")
        discard(old)
        books, moves = _renewed(blocks, books)
    coded = blocks.drop("sums").mapInArrow(_last_round(books, moves), schema)
    none = F.lit(None)
    odd = kept.where(F.size("vector") != dim).select("vec_id", "label", none.cast("string").alias("code"), none.cast("long").alias("error"))
    out = store(coded.unionAll(odd), "codes")
    discard(blocks)
    return out, books


def op12_vectors(spark, sf_dir: str) -> DataFrame:
    coded, books = quantise(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    text = ",".join(str(int(v)) for c in books for v in c.ravel())
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long")
    by_label = coded.groupBy("label").agg(whole.alias("label_error")).select(F.col("label").alias("of"), "label_error")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error"), F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain Lloyd rounds, a component a row."""
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, embedding AS e FROM embeddings WHERE {fine})",
        f"v AS MATERIALIZED (SELECT vec_id, (k - 1) // (len(e) // {PARTS}) AS part, (k - 1) % (len(e) // {PARTS}) AS k, CAST(floor({SCALE} * CAST(e[k] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS k FROM kept))",
        f"c0 AS MATERIALIZED (SELECT part, j, k, v AS c FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})) USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, min(d * {ENTRIES} + j) AS m FROM (SELECT vec_id, part, j, sum((v - c) * (v - c))::BIGINT AS d FROM v JOIN c{r} USING (part, k) GROUP BY vec_id, part, j) GROUP BY vec_id, part)")
        if r < ROUNDS:
            ctes.append(f"s{r} AS MATERIALIZED (SELECT part, m % {ENTRIES} AS j, k, sum(v)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id, part) GROUP BY ALL)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT part, j, k, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{r} LEFT JOIN s{r} USING (part, j, k))")
    ctes.append(f"done AS (SELECT vec_id, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, j, k)) FROM c{ROUNDS}) AS codebooks_sha256 FROM done JOIN kept USING (vec_id)"


OP12_SQL = _sql()
