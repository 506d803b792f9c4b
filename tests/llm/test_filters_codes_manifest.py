"""URL filters, vector codes and the Merkle manifest against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import canon
from veristrata.llm import merkle, queries, urls, vectors


@pytest.mark.parametrize("name", ["op12_vectors", "op13_merkle"])
def test_queries_equal_sql(spark, oracle, name):
    con, folder = oracle
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.sql(queries.SQL[name]).df()
    assert canon(got) == canon(want) and sorted(got.columns) == sorted(want.columns)


# ---- URL filters


def plain_parts(url):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return low(rest[:cut]), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


class PlainMarkov:
    """The same model by dictionaries."""

    def __init__(self, texts, contexts):
        self.n, size = defaultdict(Counter), 0
        for t in texts:
            s = [urls.START] * urls.ORDER + list(t) + [urls.END]
            for i in range(urls.ORDER, len(s)):
                size += 1
                for m in range(urls.ORDER + 1):
                    self.n[tuple(s[i - m : i])][s[i]] += 1
        self.n = {c: k for c, k in self.n.items() if sum(k.values()) * contexts >= size}

    def log2(self, t):
        s, total = [urls.START] * urls.ORDER + list(t) + [urls.END], 0.0
        for i in range(urls.ORDER, len(s)):
            p = 1 / urls.SYMBOLS
            for m in range(urls.ORDER + 1):
                k = self.n.get(tuple(s[i - m : i]))
                if k:
                    p = (k[s[i]] + len(k) * p) / (sum(k.values()) + len(k))
            total += math.log2(p)
        return total


def some_urls():
    rng = random.Random(4)
    out = [None, "", "no scheme", "HTTP://A.NET/x", "https://net", "https://net/", "http://X.example.net/en/1?q#f", "http://aexample.net/en/", "a://b://c.net/d", "http://h.org/fr/é", "http://h.org/fr", "http://example.com?/de/", "://", "http://a.example.com/de/\nx", "http://org/fr/" + "z" * 3000]
    good, bad = ["blog", "news", "wiki"], ["pills", "casino", "spam"]
    for i in range(400):
        tail = rng.choice(["", "?a=1", "#top", ".html"])
        out.append(rng.choice([f"https://{rng.choice(good)}{i % 30}.example.org/fr/{rng.choice(good)}-{i}{tail}", f"http://{rng.choice(bad)}{i % 30}.net/{rng.choice(bad)}-{i}{tail}"]))
    out += [f"https://{rng.choice(good)}{i}.site.com/{rng.choice(good)}-{i}" for i in range(40)] + [f"https://{rng.choice(bad)}{i}.site.com/{rng.choice(bad)}-{i}" for i in range(40)]
    return out + out[20:60]


def test_urls_equal_a_plain_model(spark):
    rows = [(i, u, "x", True, 5) for i, u in enumerate(some_urls())]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, text string, accepted boolean, gram int")).collect()}
    assert sorted(got) == [r[0] for r in rows]
    said = {i: plain_rule(*plain_parts(u)) for i, u, *_ in rows}
    raw = {i: bytes(c + 32 if 65 <= c <= 90 else c for c in (u or "").encode()) for i, u, *_ in rows}
    held = {i: zlib.crc32((u or "").encode()) % urls.FOLDS == 0 for i, u, *_ in rows}
    models = [PlainMarkov([raw[i] for i in raw if said[i][1] == v and not held[i]], urls.CONTEXTS) for v in ("block", "allow")]
    diff = {i: (models[1].log2(t) - models[0].log2(t)) / (len(t) + 1) for i, t in raw.items()}
    bins = Counter((said[i][1] == "allow", round(diff[i] * urls.STEPS)) for i in raw if said[i][1] and held[i])
    slope, base = urls.fit_curve(np.array([d for _, d in bins]) / urls.STEPS, np.array([a for a, _ in bins]), np.array(list(bins.values()), float))
    for i, u, *_ in rows:
        r = got[i]
        assert (r.host, r.path, r.rule) == (*plain_parts(u), said[i][0]), u
        assert abs(r.difference - diff[i]) < 1e-8
        assert abs(r.probability - 1 / (1 + math.exp(-(slope * diff[i] + base)))) < 1e-5
        assert r.verdict == (said[i][1] or ("allow" if r.probability >= 0.5 else "block"))
    own = [r for i, r in got.items() if rows[i][1] and "site.com" in rows[i][1]]
    assert sum(r.verdict == ("block" if any(b in r.host for b in ("pills", "casino", "spam")) else "allow") for r in own) >= 0.95 * len(own)


def test_urls_without_examples(spark):
    kind = "page_id int, url string"
    assert urls.filter_urls(spark.createDataFrame([], kind)).collect() == []
    got = urls.filter_urls(spark.createDataFrame([(1, "http://a.com/"), (None, None)], kind)).collect()
    assert {(r.page_id, r.rule, r.verdict, r.probability) for r in got} == {(1, None, "allow", 0.5), (None, None, "allow", 0.5)}


def test_a_long_url_is_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data, offs = rng.integers(97, 123, 5000, np.uint8), np.array([0, 0, 10, 4000, 4000, 5000])
    whole = [np.concatenate(x) for x in zip(*urls.grams(data, offs), strict=True)]
    monkeypatch.setattr(urls, "PIECE", 7)
    pieces = [np.concatenate(x) for x in zip(*urls.grams(data, offs), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True)) and len(whole[0]) == 5005


# ---- vector codes


def plain_quantise(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector of floats) -> {id: (code, error)} with Python integers."""
    keep = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(int(x) * 4096 if abs(x) > 2**60 else x * 4096) for x in v] for _, v in keep]
    w = len(ints[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for v in ints[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        near = [[min((dist(cut(v, p), c), j) for j, c in enumerate(books[p])) for p in range(parts)] for v in ints]
        if r < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [cut(v, p) for v, a in zip(ints, near, strict=True) if a[p][1] == j]
                    if own:
                        books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, "".join(f"{j:02x}" for _, j in a), min(sum(d for d, _ in a), 2**63 - 1)) for (i, _), a in zip(keep, near, strict=True)], books


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_vectors_equal_plain_rounds(spark, scale):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 0.01, (700, 16)) + rng.integers(0, 6, (700, 1)), 3) * scale  # clusters, ties from rounding
    x[100:160] = x[7]
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 3 if i % 5 else None) for i in range(700)]
    rows += [(700, None, 1), (701, [1.0, None] * 8, 1), (702, [math.nan] * 16, 1), (703, [math.inf] + [0.0] * 15, 1), (None, rows[3][1], 2), (5, rows[9][1], 1)]
    df = spark.createDataFrame([(i, v, lab, "x", 3) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, n int")
    coded, books = vectors.quantise(df)
    want, plain = plain_quantise([r[:2] for r in rows])
    assert [[[int(v) for v in e] for e in c] for c in books] == plain
    assert Counter((r.vec_id, r.code, r.error) for r in coded.collect()) == Counter(want)


def test_bounds_save_distances():
    rng = np.random.default_rng(6)
    x = vectors.to_integers((rng.normal(0, 0.05, (4000, 8)) + rng.integers(0, 8, (4000, 1))).astype(np.float32))
    c = x[:16].copy()
    part = vectors.Part(x)
    part.assign(c)
    first = part.distances
    for _ in range(4):
        n, s = part.sums(16)
        new = np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], c)
        part.shift(vectors._up(np.sqrt(((new - c) ** 2).sum(1).astype(float))).astype(float))
        c, part.distances = new, 0
        part.assign(c)
        d2 = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (part.a == d2.argmin(1)).all()
        assert (part.upper.astype(float) ** 2 >= d2[np.arange(len(x)), part.a]).all() and (part.lower.astype(float) ** 2 <= d2).all()
    assert part.distances < first / 4


def test_odd_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vectors.quantise(spark.createDataFrame([], kind))[0].collect() == []
    got, books = vectors.quantise(spark.createDataFrame([(1, [0.5] * 3, 1), (2, [0.25] * 4, None), (3, [0.5, 0.5, 9.0], 1)], kind))
    rows = {r.vec_id: (r.code, r.error) for r in got.collect()}
    assert rows[2] == (None, None) and rows[1] == ("00" * 8, 0) and rows[3][0] == "0000010000000000" and len(books[0]) == 2
    got, _ = vectors.quantise(spark.createDataFrame([(1, [], 1), (2, [], 1)], kind))
    assert {(r.vec_id, r.code, r.error) for r in got.collect()} == {(1, "00" * 8, 0), (2, "00" * 8, 0)}


# ---- the Merkle manifest


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(nodes):
    """(root, for each leaf its siblings (left, right) by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes, at = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], paths


def plain_manifest(rows):
    """rows (tree, id, leaf, other) -> the rows of merkle_manifest, root."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[0]].append(r)
    subs = {}
    for t, own in trees.items():
        own.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        subs[t] = plain_tree([r[2] for r in own])
    root, outer = plain_tree([subs[t][0] for t in sorted(subs, key=str.encode)])
    out = []
    for t, above in zip(sorted(subs, key=str.encode), outer, strict=True):
        for (_, i, leaf, other), path in zip(trees[t], subs[t][1], strict=True):
            x = other or leaf
            for a, b in path + above:
                x = h(a + x + b)
            out.append((i, leaf, subs[t][0], h("".join(a + b for a, b in path + above)), x))
    return out, root


@pytest.mark.parametrize("sizes", [{"s": 1}, {"n": 4096, "sa": 4097, "sb": 1}, {"n": 9000, "sé": 300, **{f"s{i}": 1 + i % 40 for i in range(60)}}])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rng = random.Random(8)
    rows = [(t, rng.choice([None, i, i, i // 2]), h(f"{t}{i // 3 * 3}"), h(f"x{i}") if i % 5 == 0 else None) for t, n in sizes.items() for i in range(n)]
    rows = list({(t, i, leaf): (t, i, leaf, o) for t, i, leaf, o in rows}.values())  # equal leaves of equal ids are interchangeable
    df = spark.createDataFrame([(t, i, bytes.fromhex(d), bytes.fromhex(o) if o else None) for t, i, d, o in rows], "tree string, id long, digest binary, other binary")
    got, root = merkle.merkle_manifest(df)
    want, expected = plain_manifest(rows)
    assert root == expected
    assert Counter(tuple(r) for r in got.select("doc_id", "leaf", "subroot", "proof_sha256", "folded_root").collect()) == Counter(want)


def test_manifest_of_awkward_rows(spark, tmp_path):
    rows = [(1, "a\nB", "en", "s", 3), (1, "a\nB", "en", "s", 3), (None, None, None, None, None), (5, "ÄBC" * 2000, "de", "", 6000), (10, "", "x:", "S", 0), (7, None, "en", None, None), (15, "nothing to lower", None, "s", 16)]
    spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, idx int, tree string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_merkle"](spark, str(tmp_path)).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: h("".join(field(v) for v in (i, s, lang, n, t)))
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    bad = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    plain = [("n" if s is None else "s" + s, i, leaf(i, t, lang, s, n), leaf(i, low(t), lang, s, n) if bad(i) and low(t) != t else None) for i, t, lang, s, n in rows]
    want, root = plain_manifest(plain)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.proof_sha256, r.folded_root) for r in got) == Counter(want)
    assert {r.root for r in got} == {root} and all(r.verified == (r.folded_root == root) for r in got) and sum(r.verified for r in got) == len(rows) - sum(o is not None for *_, o in plain)


def test_manifest_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op13_merkle"](spark, str(tmp_path)).collect() == []


def test_many_buckets_in_one_arrow_batch():
    """What Spark sends as one batch may hold more buckets than the memory of a DuckDB connection."""
    n, many = merkle.BUCKET, 40
    leaves = [h(f"leaf{i}") for i in range(n)]
    subroot, paths = plain_tree(leaves)
    items = pa.StructArray.from_arrays([pa.array(list(range(n)) * many, pa.int64()), pa.nulls(n * many, pa.string()), pa.array([bytes.fromhex(x) for x in leaves] * many), pa.nulls(n * many, pa.binary())], ["id", "name", "digest", "other"])
    buckets = pa.ListArray.from_arrays(pa.array(range(0, n * many + 1, n), pa.int32()), items)
    own = {"tree": pa.array([f"s{k}" for k in range(many)]), "idx": pa.array([0] * many, pa.int64()), "n": pa.array([n] * many, pa.int64()), "items": buckets}
    above = pa.array([["aa"]] * many, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_pydict(own | {"lefts": above, "rights": above, "subroot": pa.array([subroot] * many)})
    got = pa.Table.from_batches(merkle._proven([batch]))
    assert got.column("doc_id").to_pylist() == list(range(n)) * many and got.column("leaf").to_pylist() == leaves * many
    assert got.column("proof_sha256").to_pylist() == [h("".join(a + b for a, b in path) + "aaaa") for path in paths] * many
    assert set(got.column("folded_root").to_pylist()) == {h("aa" + subroot + "aa")}
    assert [x for b in merkle._roots([pa.RecordBatch.from_pydict(own)]) for x in b.column("digest").to_pylist()] == [bytes.fromhex(subroot)] * many
    assert sum(b.num_rows for b in merkle._paths([batch])) == n * many
