"""URL filters: allow and block rules by host and path, then a character language-model ratio.

The URLs that the rules decide are the accepted and rejected examples. Each class has a variable-order Markov model over the
bytes of whole URLs (A-Z lower-cased, an end symbol after the last): all its 6-grams are counted, shorter contexts are their
sums, and a context takes part if it precedes at least one in CONTEXTS of the class's symbols, so a model has a fixed
largest size whatever the input. Probabilities are smoothed from the shorter context up (Witten-Bell). A fifth of the
examples (by crc32 of the URL) is kept out of the counts; on it a logistic curve is fitted to the difference of the two
log-likelihoods per symbol, both classes weighing the same. An URL passes at a probability of one half or more.

Nulls and ties: a null URL is an empty one; without ``://`` host and path are empty, and no rule fits. Of several fitting
rules the longest (host and path) wins, then the one with the longer host, then block. Without examples of both classes, or
where the difference does not separate them, the curve is the plain one (half at a difference of nought). Repeated URLs count
as often as they occur. Other columns are ignored. An empty table has an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import _LOWER, slices, table, text_buffers, tidy

#: (verdict, host, path): fixed values of the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER = 5
CONTEXTS = 2048
#: Symbols before a text and after it; bytes that UTF-8 never has.
START, END = 0xFE, 0xFF
SYMBOLS = 256
FOLDS = 5
#: Steps of the difference per symbol on which the curve is fitted, a bit, and their largest number.
STEPS, MOST = 256, 4096
#: Symbols that are handled at a time; parts of a bit in which differences are added up.
PIECE, UNIT = 1 << 18, 1 << 32
#: Distinct 6-grams that a task holds before it passes them on.
HELD = 1 << 20
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _AZ, _AZ.lower())


def path_of(url):
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=None):
    """struct(verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, h, p in sorted(RULES if rules is None else rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def grams(data: np.ndarray, offs: np.ndarray):
    """Of each symbol: the ORDER bytes before it and itself as one number, and which text it is of; in pieces of PIECE symbols."""
    n = np.diff(offs) + 1
    wide = n + ORDER  # starts, text, end
    at = np.cumsum(wide) - wide
    seq = np.full(int(wide.sum()), START, np.uint8)
    for i in range(len(n)):
        seq[at[i] + ORDER : at[i] + wide[i] - 1] = _LOWER[data[offs[i] : offs[i + 1]]]
    seq[at + wide - 1] = END
    ends = np.cumsum(n)
    for low in range(0, int(ends[-1]) if len(ends) else 0, PIECE):
        symbol = np.arange(low, min(low + PIECE, int(ends[-1])))
        of = np.searchsorted(ends, symbol, side="right")
        places = symbol + ORDER * (of + 1)
        out = np.zeros(len(places), np.uint64)
        for back in range(ORDER, -1, -1):
            out = (out << np.uint64(8)) | seq[places - back]
        yield out, of


def _count(batches):
    """(accepted, gram, n) of the batches' texts."""
    held = {False: [], True: []}
    size = 0

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        u, inv = np.unique(keys, return_inverse=True)
        return u, np.bincount(inv, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

    def out():
        for accepted, parts in held.items():
            if parts:
                u, c = merged(parts)
                for i in range(0, len(u), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([accepted] * len(u[i : i + 50_000])), pa.array(u[i : i + 50_000].astype(np.int64)), pa.array(c[i : i + 50_000])], ["accepted", "gram", "n"])
                parts.clear()

    for b in slices(batches):
        flags = b.column("accepted").to_numpy(zero_copy_only=False).astype(bool)
        data, offs = text_buffers(b.column("text"))
        for code, of in grams(data, offs):
            for accepted in (False, True):
                u, c = np.unique(code[flags[of] == accepted], return_counts=True)
                if len(u):
                    held[accepted].append((u, c))
                    size += len(u)
        if size > HELD:
            for parts in held.values():
                if parts:
                    parts[:] = [merged(parts)]
            size = sum(len(u) for parts in held.values() for u, _ in parts)
            if size > HELD // 2:
                yield from out()
                size = 0
    yield from out()
    tidy()


class Markov:
    """One class's model: for each order its contexts with their totals and numbers of continuations, and the counts of their grams."""

    def __init__(self):
        none = np.zeros(0, np.uint64)
        self.orders = [(none, none, none, none, none)] * (ORDER + 1)

    def learn(self, order: int, gram: np.ndarray, n: np.ndarray) -> None:
        gram = gram.astype(np.uint64)
        sort = np.argsort(gram)
        gram, n = gram[sort], n[sort].astype(np.float64)
        context, first = np.unique(gram >> np.uint64(8), return_index=True)
        ends = np.append(first[1:], len(gram))
        self.orders[order] = (context, np.add.reduceat(n, first) if len(n) else n, (ends - first).astype(np.float64), gram, n)

    def log2(self, gram: np.ndarray) -> np.ndarray:
        """log2 probability of each gram's symbol after its context."""
        p = np.full(len(gram), 1 / SYMBOLS)
        for m, (contexts, total, kinds, known, n) in enumerate(self.orders):
            if not len(contexts):
                continue
            own = gram & np.uint64((1 << (8 * (m + 1))) - 1)
            c = np.minimum(np.searchsorted(contexts, own >> np.uint64(8)), len(contexts) - 1)
            g = np.minimum(np.searchsorted(known, own), len(known) - 1)
            has = contexts[c] == own >> np.uint64(8)
            count = np.where(known[g] == own, n[g], 0.0)
            p = np.where(has, (count + kinds[c] * p) / (total[c] + kinds[c]), p)
        return np.log2(p)


class UrlModel:
    def __init__(self, rejected: Markov, accepted: Markov):
        self.rejected, self.accepted, self.slope, self.base = rejected, accepted, 1.0, 0.0

    def difference(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """log2-likelihood of the accepted class less that of the rejected one, per symbol."""
        total, n = np.zeros(len(offs) - 1, np.int64), np.diff(offs) + 1
        for code, of in grams(data, offs):
            u, inv = np.unique(code, return_inverse=True)
            d = np.rint((self.accepted.log2(u) - self.rejected.log2(u)) * UNIT).astype(np.int64)[inv]
            np.add.at(total, of, d)  # integers: the same sum in any order
        return total / UNIT / n

    def probability(self, d: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * d + self.base, -500, 500)))


def fit_curve(d: np.ndarray, accepted: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(slope, base) of a logistic curve, classes weighing the same; (1, 0) without both classes or a rising curve."""
    if not n[accepted].sum() or not n[~accepted].sum():
        return 1.0, 0.0
    w = np.where(accepted, n / n[accepted].sum(), n / n[~accepted].sum()) / 2
    z, y, v, ridge = np.stack([d, np.ones_like(d)], 1), accepted.astype(float), np.array([1.0, 0.0]), np.diag([1e-4, 1e-6])
    loss = lambda v: float((w * np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ v))).sum() + 0.5 * v @ ridge @ v)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -500, 500)))
        grad = z.T @ (w * (p - y)) + ridge @ v
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, grad)
        size = 1.0
        while loss(v - size * step) > loss(v) and size > 1e-9:
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-12:
            break
    return (float(v[0]), float(v[1])) if v[0] > 0 else (1.0, 0.0)


def train_url_model(urls: DataFrame, contexts: int = CONTEXTS) -> UrlModel:
    """urls: text, accepted (null: no example)."""
    spark = urls.sparkSession
    known = urls.where("accepted IS NOT NULL")
    kept_out = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(FOLDS)) == 0
    counts = known.where(~kept_out).mapInArrow(_count, "accepted boolean, gram long, n long").groupBy("accepted", "gram").agg(F.sum("n").alias("n"))
    part = lambda m: F.col("gram").bitwiseAND((1 << (8 * (m + 1))) - 1)
    each = counts.select("accepted", "n", F.posexplode(F.array(*[part(m) for m in range(ORDER + 1)])).alias("m", "gram")).groupBy("accepted", "m", "gram").agg(F.sum("n").alias("n"))
    context = each.withColumn("context", F.shiftrightunsigned("gram", 8))
    totals = context.groupBy("accepted", "m", "context").agg(F.sum("n").alias("total"), F.collect_list(F.struct("gram", "n")).alias("grams"))  # 256 grams a context at most
    symbols = {r.accepted: r.n for r in known.where(~kept_out).groupBy("accepted").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
    model = UrlModel(Markov(), Markov())
    if symbols:
        floor = F.when(F.col("accepted"), symbols.get(True, 0)).otherwise(symbols.get(False, 0))
        # 2 classes x 6 orders x CONTEXTS contexts x 256 symbols at the very most
        rows = totals.where(F.col("total") * contexts >= floor).select("accepted", "m", F.explode("grams").alias("g")).select("accepted", "m", "g.gram", "g.n").toArrow()
        accepted, m, gram, n = (rows.column(c).to_numpy() for c in ("accepted", "m", "gram", "n"))
        for own, markov in ((False, model.rejected), (True, model.accepted)):
            for order in range(ORDER + 1):
                at = (accepted == own) & (m == order)
                markov.learn(order, gram[at], n[at])
    held = spark.sparkContext.broadcast(model)

    def bins(batches):
        for b in slices(batches):
            d = held.value.difference(*text_buffers(b.column("text")))
            at = np.clip(np.rint(d * STEPS), -MOST, MOST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("accepted"), pa.array(at)], ["accepted", "bin"])

    # a row for each step and class
    got = known.where(kept_out).mapInArrow(bins, "accepted boolean, bin int").groupBy("accepted", "bin").count().toArrow()
    if got.num_rows:
        model.slope, model.base = fit_curve(got.column("bin").to_numpy() / STEPS, got.column("accepted").to_numpy().astype(bool), got.column("count").to_numpy().astype(float))
    return model


def filter_urls(pages: DataFrame, rules=None) -> DataFrame:
    """pages: page_id, url. Returns page_id, host, path, rule, verdict, difference (bits a symbol), probability (of being accepted)."""
    spark = pages.sparkSession
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parsed = pages.select("page_id", url.alias("text"), host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "text", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("said"))
    model = spark.sparkContext.broadcast(train_url_model(parsed.select("text", (F.col("said") == "allow").alias("accepted"))))

    def run(batches):
        for b in slices(batches):
            d = model.value.difference(*text_buffers(b.column("text")))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("page_id", "host", "path", "rule", "said")], pa.array(d), pa.array(model.value.probability(d))], ["page_id", "host", "path", "rule", "said", "difference", "probability"])

    kind = dict(parsed.dtypes)["page_id"]
    done = parsed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, said string, difference double, probability double")
    judged = F.when(F.col("probability") >= 0.5, "allow").otherwise("block")
    return done.select("page_id", "host", "path", "rule", F.coalesce("said", judged).alias("verdict"), "difference", "probability")


def op11_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
