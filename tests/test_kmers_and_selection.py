"""Packed k-mers, families by places, exact selection, draws that are made once."""

import math
import random
import statistics
from collections import Counter, defaultdict

import pytest

from veristrata.operators import graph, kmers, resample, stats


def texts(rng, n, letters="ABCD", most=60):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


def plain_kmers(text, k):
    return [text[i : i + k] for i in range(len(text or "") - k + 1) if all("A" <= c <= "Z" for c in text[i : i + k])]


def test_library_sizes(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(kmers, "LETTERS", 500)  # several parts
    own = [[*texts(rng, 80), None, "", "AB*CDABCD", "é" + "ABCDA"] for _ in range(3)]
    frames = [spark.createDataFrame([(t, 1, "x") for t in part], "text string, i int, run string") for part in own]
    got = kmers.library_union(*frames, 5).first().asDict()
    a, b, c = ({w for t in part for w in plain_kmers(t, 5)} for part in own)
    assert got == {"n_a": len(a), "n_b": len(b), "n_both": len(a & b), "n_canon": len(c), "hit_a": len(a & c), "hit_b": len(b & c), "hit_both": len(a & b & c), "u": len(a | b), "h": len((a | b) & c)}
    none = frames[0].limit(0)
    assert set(kmers.library_union(none, none, none, 5).first()) == {0}


@pytest.mark.parametrize("held", [kmers.HELD, 0])
def test_family_counts_every_place(spark, held, monkeypatch):
    """With repeats, several texts of a parent and of an id, members of the pool left out."""
    rng = random.Random(3)
    monkeypatch.setattr(kmers, "HEAVY", 20)  # salted
    members = [(f"p{i % 7}", t) for i, t in enumerate(texts(rng, 12))] + [("p1", "ABABABABABAB"), ("p2", None), (None, "ABCDABCD")]
    pool = [(f"g{i % 30}", t) for i, t in enumerate(texts(rng, 50))] + [("g1", "ABABABABABABABAB"), ("p3", "ABCDABCDABCD"), ("g2", None), (None, "ABAB"), *[(f"h{i}", "ABABAB") for i in range(60)]]
    index = defaultdict(set)
    for p, t in members:
        if p:
            for w in plain_kmers(t, 4):
                index[w].add(p)
    want = Counter()
    for g, t in pool:
        if g and g not in {p for p, _ in members}:
            for w in plain_kmers(t, 4):
                for p in index[w]:
                    want[p, g] += 1
    a = spark.createDataFrame(members, "member string, text string")
    b = spark.createDataFrame(pool, "gene string, text string").repartition(3)
    got = {(r.member, r.gene): r.places for r in kmers.family_counts(a, b, 4, held=held).collect()}
    assert got == dict(want)
    assert kmers.family_counts(a.limit(0), b, 4, held=held).count() == 0


def test_stars_have_the_components_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(texts(rng, 60, "ABCDEFGH", 12))] + [(100 + i, "ZZZZZ") for i in range(300)]
    edges = kmers.star_edges(spark.createDataFrame(rows, "node long, text string"), "node", "text", 4)
    assert edges.count() < 2 * sum(len(set(plain_kmers(t, 4))) for _, t in rows)
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    low = {i: i for i, _ in rows}
    sets = {i: set(plain_kmers(t, 4)) for i, t in rows}
    changed = True
    while changed:
        changed = False
        for i in low:
            for j in low:
                if i != j and sets[i] & sets[j] and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    assert got == {i: c for i, c in low.items() if any(j != i and sets[i] & sets[j] for j in low)}


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "steep", "odd"])
def test_selection_in_rounds(spark, monkeypatch, kind):
    rng = random.Random(7)
    monkeypatch.setattr(stats, "FEW", 10)
    make = {"spread": lambda: rng.gauss(0, 5), "ties": lambda: float(rng.choice([1, 1, 1, 2, 7])), "two": lambda: float(rng.random() < 0.5), "steep": lambda: math.exp(rng.uniform(-300, 300)), "odd": lambda: rng.choice([math.inf, -math.inf, rng.random()])}[kind]
    values = [make() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "v double").repartition(4)
    values.sort()
    places = [0, 1, 20, 1499, 1500, 2700, 2999]
    assert stats.nth_values(df, "v", [*places, 3000, -1]) == [*[values[i] for i in places], None, None]
    if kind != "odd":
        assert math.isclose(stats.exact_percentile(df, "v", 0.5), statistics.median(values))
        want = df.selectExpr("percentile(v, 0.9)").first()[0]
        assert math.isclose(stats.exact_percentile(df, "v", 0.9), want)
    assert stats.exact_percentile(df.limit(0), "v", 0.5) is None
    nan = spark.createDataFrame([(1.0,), (math.nan,)], "v double")
    assert stats.nth_values(nan, "v", [0])[0] == 1.0 and math.isnan(stats.nth_values(nan, "v", [1])[0])


def test_draws_are_made_once(spark, monkeypatch):
    """In slices and blocks of any size the same counts, each draw in one of them."""
    monkeypatch.setattr(resample, "DRAWS", 37)
    many, rounds = 103, 5
    got = defaultdict(Counter)
    import zlib

    import numpy as np

    for r in resample._draw_counts(spark, rounds, many, 9, 10, 3).collect():
        at = np.cumsum(np.frombuffer(zlib.decompress(r["at"]), np.uint32))
        assert r["_group"] == r["replicate"] % 3 and at.max() < 10
        for a, n in zip(at, np.frombuffer(zlib.decompress(r["times"]), np.uint32), strict=True):
            got[r["replicate"]][r["_block"] * 10 + int(a)] += int(n)
    assert got == {r: Counter(resample.lcg_draws(9, r * many, many, many).tolist()) for r in range(rounds)}


@pytest.mark.parametrize("held", [kmers.HELD, 0])
def test_short_sequences_in_their_own_group(spark, held):
    rng = random.Random(8)
    refs = [(f"g{i % 9}", t) for i, t in enumerate(texts(rng, 60))] + [("g1", None), (None, "ABCD"), ("other", "ABCDABCDABCD"), ("g2", "AB*CD")]
    queries = [(rng.choice(texts(rng, 1, most=13)) or "A", f"g{rng.randrange(11)}") for _ in range(300)] + [(t[3:9], g) for g, t in refs if t and g] + [("", "g1"), (None, "g1"), ("AB", None), ("AB*", "g2"), ("ABCDABCDABCDA", "other")]
    want = {(s, g) for s, g in queries if s and g and s.isalpha() and len(s) <= 12 and any(r == g and t and s in t for r, t in refs)}
    q, r = spark.createDataFrame(queries, "seq string, gene string"), spark.createDataFrame(refs, "gene string, text string").repartition(3)
    assert {tuple(x) for x in kmers.held_by_group(q, r, "gene", held=held).select("seq", "gene").collect()} == want
    assert kmers.held_by_group(q.limit(0), r, "gene", held=held).count() == 0 and kmers.held_by_group(q, r.limit(0), "gene", held=held).count() == 0


def test_draws_from_any_number_of_items(monkeypatch):
    """The distribution of numpy's draws where numpy can, and the right moments beyond it."""
    import numpy as np

    cases = [(5000, 9000, 3000), (9000, 5000, 12000), (2500, 80_000, 40_000), (400, 6000, 2000), (6000, 8000, 300)]
    for good, bad, n in cases:
        want = np.random.default_rng(1).hypergeometric(good, bad, n, 6000)
        with monkeypatch.context() as m:
            m.setattr(resample, "NUMPY_ITEMS", 0)
            rng = np.random.default_rng(2)
            got = np.array([resample.hypergeometric(rng, good, bad, n) for _ in range(6000)])
        cuts = np.quantile(want, [0.05, 0.25, 0.5, 0.75, 0.95])
        assert np.abs((got[:, None] <= cuts).mean(0) - (want[:, None] <= cuts).mean(0)).max() < 0.035
        assert abs(got.mean() - want.mean()) < 0.12 * want.std() and abs(got.std() / want.std() - 1) < 0.05
    good, bad, n = 3 * 10**12, 7 * 10**12, 10**11
    rng = np.random.default_rng(3)
    got = np.array([resample.hypergeometric(rng, good, bad, n) for _ in range(2000)], float)
    spread = math.sqrt(n * 0.3 * 0.7 * (1 - n / (good + bad)))
    assert abs(got.mean() - 3 * 10**10) < 5 * spread / math.sqrt(2000) and abs(got.std() / spread - 1) < 0.08
    labels = np.array([2 * 10**12, 10**12, 5], np.int64)
    hits = [resample.permuted_hits(np.random.default_rng(i), labels, labels[::-1].copy()) for i in range(20)]
    assert abs(np.mean(hits) / (2 * 5 * 2 * 10**12 / labels.sum() + 10**24 / labels.sum()) - 1) < 0.01


def test_digests_of_long_files(spark, tmp_path, monkeypatch):
    import hashlib

    from veristrata.sources import readers

    (tmp_path / "a").write_bytes(b"x" * 100_001)
    (tmp_path / "b").write_bytes(b"")
    with open(tmp_path / "c", "wb") as f:  # longer than a row can hold, without using the disk
        f.truncate((2 << 30) + 10)
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in readers.digests(spark, str(tmp_path)).collect()}
    long = hashlib.sha256()
    for _ in range(1 << 8):
        long.update(bytes(8 << 20))
    long.update(bytes(10))
    assert got == {"a": (100_001, hashlib.sha256(b"x" * 100_001).hexdigest()), "b": (0, hashlib.sha256(b"").hexdigest()), "c": ((2 << 30) + 10, long.hexdigest())}


def test_symbols_through_four_registries(spark):
    from veristrata.operators import registry

    info = spark.createDataFrame([("1", "symbol", "ABC1", 1), ("2", "symbol", "abc1", 2), ("3", "synonym", "TWO", 3), ("4", "synonym", "two", 4), ("5", "synonym", "One", 5), ("5", "synonym", "ONE", 6), ("6", "xref", "ENSG1", 7), ("7", "xref", "ENSG1", 8)], "gene_id string, kind string, name string, _row_idx long")
    hgnc = spark.createDataFrame([("OLD", "8", 1), ("ABC1", "9", 0), ("ONE", "10", 2)], "name string, gene_id string, kind int")
    names = spark.createDataFrame([("clone-1", "ENSG1"), ("TWO", "ENSG1"), ("nowhere", "ENSG9")], "gene_name string, gene_id string")
    keys = ["Abc1 ", "old", "one", "two", "Clone-1", "nowhere", "", None, "none"]
    got = registry.symbol_to_gene(spark.createDataFrame(list(enumerate(keys)), "i int, s string"), "s", info, hgnc, names)
    assert {r.i: (r.id, r.route) for r in got.collect()} == {0: ("2", "symbol"), 1: ("8", "registry"), 2: ("10", "registry"), 3: ("7", "annotation"), 4: ("7", "annotation"), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)}
