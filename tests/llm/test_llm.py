import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import canon
from veristrata.llm import chat, dac, decontaminate, flac, jaccard, langid, lm, media, packing, substring, suffix
from veristrata.llm.common import ChunkCoder, text_buffers

DOC = "doc_id long, text string, lang string, kept string, src long, bucket string, shared string, n long"
FOLDER = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Rows (id, text), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "x", 1, "b", "s", 2) for i, t in rows], DOC)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(seed):
    """Copies, near copies, shared passages, repeats, ties, nulls, empty and long texts."""
    rng = random.Random(seed)
    base, passage = prose(rng, 180), prose(rng, 70)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (9, base), (6, base.replace("w1", "q9", 2)), (7, prose(rng, 40) + " " + passage + "\n" + prose(rng, 30)), (8, prose(rng, 25) + "  " + passage)]
    rows += [(10, "a " * 300), (11, "a " * 120), (12, prose(rng, 6000)), (13, "é" * 60 + " ß"), (14, "é" * 60 + " x"), (15, "one two"), (16, "one  Two"), (17, "one"), (None, base), (4, prose(rng, 60))]
    rows += [(20 + i, " ".join(w if rng.random() > 0.004 else "z" for w in base.split())) for i in range(12)]
    rng.shuffle(rows)
    return rows


BIG = 1 << 62


def key(i):
    return BIG if i is None else i


def brute_spans(units, k):
    """units: [(id, list)] -> covered flags, by the contract."""
    least = {}
    for i, u in units:
        for p in range(len(u) - k + 1):
            w = tuple(u[p : p + k])
            least[w] = min(least.get(w, BIG + 1), key(i))
    out = []
    for i, u in units:
        gone = [False] * len(u)
        for p in range(len(u) - k + 1):
            if least[tuple(u[p : p + k])] < key(i):
                gone[p : p + k] = [True] * k
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_and_suffix(spark, seed):
    rows = awkward(seed)
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    want = Counter((i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for (i, w), g in zip(words, brute_spans(words, 50), strict=True))
    assert Counter(map(tuple, substring.dedup_words(docs(spark, rows), texts=False).collect())) == want
    raw = [(i, list((t or "").encode())) for i, t in rows]
    want = Counter()
    for (i, b), g in zip(raw, brute_spans(raw, 50), strict=True):
        spans = sum(1 for p, x in enumerate(g) if x and (p == 0 or not g[p - 1]))
        want[i, len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()] += 1
    assert Counter(map(tuple, suffix.dedup_bytes(docs(spark, rows), texts=False).collect())) == want


@pytest.mark.parametrize("fold", [4096, 1])
def test_hot_windows_travel_singly(spark, monkeypatch, fold):
    from veristrata.llm import superkmer

    monkeypatch.setattr(superkmer, "HOT", 1)
    monkeypatch.setattr(superkmer, "FOLD", fold)
    rows = [r for r in awkward(3) if r[0] != 12]
    words = [(i, (t or "").split()) for i, t in rows]
    want = Counter((i, sum(g)) for (i, _), g in zip(words, brute_spans(words, 50), strict=True))
    assert Counter((r.doc_id, r.n_removed) for r in substring.dedup_words(docs(spark, rows)).collect()) == want


def test_suffix_parts_merge(monkeypatch):
    monkeypatch.setattr(suffix, "PART_BYTES", 300)
    rng = random.Random(5)
    strings = list({"".join(rng.choice("ab") * rng.randrange(1, 9) for _ in range(14)).encode()[:70].ljust(52, b"x") for _ in range(120)})
    lo, w = np.array([rng.randrange(30) for _ in strings]), np.array([len(s) - 49 for s in strings])
    least = {}
    for s, m in zip(strings, lo, strict=True):
        for p in range(len(s) - 49):
            least[s[p : p + 50]] = min(least.get(s[p : p + 50], 99), int(m))
    want = [least[s[p : p + 50]] for s in strings for p in range(len(s) - 49)]
    assert suffix.equal_byte_windows(strings, lo, w).tolist() == want
    text = np.frombuffer(b"banana bandana banana", np.uint8)
    key_ = suffix.words_at(text)
    sa, tied, apart = suffix.suffix_array(key_)
    shared = lambda a, b, most=64: next((k for k in range(most) if max(a, b) + k >= len(text) or text[a + k] != text[b + k]), most)
    assert suffix.common_prefixes(key_, sa, tied, np.zeros(len(sa), bool), 64)[1:].tolist() == [shared(a, b) for a, b in zip(sa, sa[1:], strict=False)] and not tied.any()
    long = np.tile(np.frombuffer(b"the same words come again and again, ", np.uint8), 6)
    long[100] = long[170] = 33
    k2 = suffix.words_at(long)
    sa2, tied2, apart2 = suffix.suffix_array(k2)
    pairs = list(zip(sa2.tolist(), sa2[1:].tolist(), strict=False))
    same = [next((k for k in range(64) if (0 if a + k >= len(long) else long[a + k]) != (0 if b + k >= len(long) else long[b + k])), 64) for a, b in pairs]
    got = suffix.common_prefixes(k2, sa2, tied2, apart2, 64)[1:]
    assert all((x >= 50) == (y >= 50) for x, y in zip(got.tolist(), same, strict=True)) and all(y < 32 for y, f in zip(same, apart2[1:], strict=True) if f)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text.tobytes()[i:])


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = [key(i) for i, _ in rows]
    ids = {}
    for n, (i, _) in enumerate(rows):
        ids.setdefault(key(i), []).append(n)
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    change = True
    while change:
        change = False
        for a, b in edges:
            m = min(low[a], low[b])
            change |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return Counter((i, len(s), None if x == BIG else x) for (i, _), s, x in zip(rows, sets, low, strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard(spark, seed):
    rows = [r for r in awkward(seed) if r != (4, None)]
    rows = [r for n, r in enumerate(rows) if r[0] not in [x[0] for x in rows[:n]]]  # one row an id
    assert Counter(map(tuple, jaccard.jaccard_components(docs(spark, rows)).collect())) == brute_components(rows)


def test_jaccard_residual_lists_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng, rows = random.Random(9), []
    for g in range(6):  # chains of texts that change by and by
        w = prose(rng, 60).split()
        for i in range(15):
            for _ in range(1):
                w[rng.randrange(60)] = f"v{g}_{i}"
            rows.append((g * 100 + i, " ".join(w)))
    assert Counter(map(tuple, jaccard.jaccard_components(docs(spark, rows)).collect())) == brute_components(rows)


def test_lists_with_and_without_document_0_differ():
    a, b = np.array([0, 5, 9]), np.array([5, 9])
    for side_a, side_b in ((None, None), (np.array([False, True, False]), np.array([True, False]))):
        one, two = jaccard.marks_of(a, side_a), jaccard.marks_of(b, side_b)
        assert one[0] != two[0] and one[1] != two[1]


def test_tree_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 1 << 40, 300).astype(np.uint64)
        sets += [np.append(base[: rng.integers(220, 300)], rng.integers(0, 1 << 40, 20).astype(np.uint64)) for _ in range(5)]
    sizes = np.array([len(s) for s in sets])
    links = jaccard.tree_join(list(range(100)), sizes, sets, np.arange(100))
    parent = list(range(100))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    for a in range(100):
        for b in range(a):
            k = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if jaccard.linked(len(sets[a]), len(sets[b]), k):
                assert root(a) == root(b)


def test_lm_base_is_exact_and_model_is_better(spark):
    rng = random.Random(4)
    rows = [(i, None if i == 3 else prose(rng, rng.randrange(0, 120), 60) if i % 2 else " ".join(f"x{(j * 7 + i) % 9}" for j in range(80))) for i in range(120)]
    got = {r.doc_id: r for r in lm.score_texts(docs(spark, rows)).collect()}
    toks = {i: [*(t or "").split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    on = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in on) > sum(r.base_score for r in on)
    assert lm.score_texts(docs(spark, rows).limit(0)).count() == 0


def test_lm_score_is_the_models_probability(spark, monkeypatch):
    monkeypatch.setattr(lm, "LISTED", 40)
    rng = random.Random(5)
    rows = [(i, " ".join(f"{'abc'[rng.randrange(3)]}{min(int(rng.paretovariate(0.8)), 90)}x{'st'[i % 2]}." for _ in range(rng.randrange(1, 60)))) for i in range(150)] + [(None, ""), (7, None)]
    packed = lm.pack(docs(spark, rows), "texts")
    f = lm.fit(packed)
    m, index = f.model, {w: i for i, w in enumerate(f.listed)}
    assert len(f.listed) == 40
    train = [(t or "").split() for i, t in rows if not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)]
    c = Counter(w for t in train for w in t)
    cls = lambda w: int(lm.classes_of(f.listed)[index[w]]) if w in index else int(lm.bucket_of_ending(pa.array([w]))[0])
    out = lambda w: index.get(w, 40 + cls(w))
    rare_n, rare_v = Counter(), Counter()
    for w, n in c.items():
        if w not in index:
            rare_n[cls(w)] += n
            rare_v[cls(w)] += 1

    def of_class(last, two):
        z = m.class_logs(m.shape.history_of[np.array([last])], np.array([two]))[0]
        assert math.isclose(float(np.exp(z.astype(np.float64)).sum()), 1, abs_tol=1e-4)
        return z

    def of_word(last, k):
        own = np.flatnonzero(m.shape.class_of_outcome == k)
        z = m.outcome_logs(np.full(len(own), last), own)
        assert math.isclose(float(np.exp(z.astype(np.float64)).sum()), 1, abs_tol=1e-3)
        return dict(zip(own.tolist(), z.tolist(), strict=True))

    want = []
    for i, t in rows:
        total, last, one, two = 0.0, 40, 0, 0
        for w in [*(t or "").split(), None]:
            k, o = (0, 40) if w is None else (cls(w), out(w))
            total += (float(of_class(last, two)[k]) + of_word(last, k)[o]) / math.log(10)
            if w is not None and w not in index:
                total += math.log10((c[w] + 1) / (rare_n[k] + rare_v[k] + 1))
            last, two, one = o, one, k
        want.append((key(i), total))
    got = sorted((key(r.doc_id), r.score) for r in lm.score_packed(packed, f).collect())
    assert all(i == j and math.isclose(a, b, abs_tol=0.01) for (i, a), (j, b) in zip(got, sorted(want), strict=True))


def test_lm_learns_from_the_words_before(spark):
    rng = random.Random(3)
    follow = {f"w{i}": f"w{(i * 17 + 5) % 50}" for i in range(50)}
    rows = []
    for i in range(300):
        w = [f"w{rng.randrange(50)}"]
        while len(w) < 40:
            w.append(follow[w[-1]] if rng.random() < 0.9 else f"w{rng.randrange(50)}")
        rows.append((i, " ".join(w)))
    on = [r for r in lm.score_texts(docs(spark, rows)).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in on)
    assert -sum(r.score for r in on) / tokens < 0.5 * -sum(r.base_score for r in on) / tokens


def test_langid(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").union(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 3!", "en", "s", 0), (-3, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    model = langid.train_language_model(d)
    got = langid.predict_languages(d, model).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id < 0} == {-1: "und", -2: "und", -3: "und"}
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.predict_languages(d, None).collect()} == {"und"}
    assert langid.train_language_model(d.limit(0)) is None


def test_langid_sample_is_bounded(spark, monkeypatch):
    got = {}
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda labels, x: got.update(n=Counter(labels)) or fit(labels, x))
    rows = [(None, f"some words of number {i}" if i % 3 else "a copy of many") for i in range(900)] + [(7, f"des mots {i}") for i in range(400)] + [(8, "le même texte")] * 500
    d = spark.createDataFrame([(i, t, "en" if n < 900 else "fr", "x", "y") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, at string, k string")
    model = langid.train_language_model(d, sample=50, total=90)
    assert got["n"] == {"en": 45, "fr": 45}
    assert {r.lang_pred for r in langid.predict_languages(d, model).collect()} == {"en", "fr"}


def test_langid_repeated_ids_and_clashing_columns(spark):
    rows = [(4, "the cat and the dog", "en"), (4, "le chat et le chien", "fr"), (None, "the house and the tree", "en"), (4, "la maison et le bois", "fr")] * 5
    d = spark.createDataFrame([(i, t, c, "s", 0.5, "z") for i, t, c in rows], "doc_id long, text string, lang string, at string, score double, lang_pred string")
    got = langid.predict_languages(d, langid.train_language_model(d), keep=["doc_id", "lang"]).collect()
    assert len(got) == 20 and all(r.lang == r.lang_pred for r in got)


def test_langid_query_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = [r for r in langid.op3_langid(spark, FOLDER).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_chunked_ids_are_those_of_whole_texts(name, kind):
    tokenizers, paths = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tok, rng = tokenizers.Tokenizer.from_file(paths.path(name)), random.Random(1)
    parts = [*"aAbé ÈZ  \n\n\t\r.,!'’s re ve0129×÷ß ́İΣς中文<|>_-", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "don't", " the", " \n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    ids, at = ChunkCoder(paths.path(name), kind).encode(*text_buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def best_fit(lengths, size):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(size - x)
    return len(gaps)


def filled(plan):
    """The lengths in each sequence of a plan; checks ranks and offsets."""
    fill, seen = {}, Counter()
    for length, r0, m, base, off in plan.tolist():
        assert r0 == seen[length]
        seen[length] += m
        for s in range(base, base + m):
            fill.setdefault(s, []).append((off, length))
    for parts in fill.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
    return fill, seen


@pytest.mark.parametrize("low,high,size,n", [(1, 64, 64, 300), (1, 4096, 4096, 3000), (500, 2500, 4096, 4000), (1300, 1500, 4096, 900)])
def test_packing_plan(low, high, size, n):
    lengths = np.random.default_rng(2).integers(low, high + 1, n)
    counts = np.bincount(lengths, minlength=size + 1)
    for share in packing.SHARES:
        fill, seen = filled(packing._plan_from(counts, size, share).arrays())
        assert seen == Counter(lengths.tolist()) and all(sum(x for _, x in p) <= size for p in fill.values())
    best = best_fit(lengths.tolist(), size)
    assert len(fill) <= best  # share 1: fills that begin with best fit's own choice
    fill, _ = filled(packing.plan_lengths(counts, size))
    assert len(fill) <= best


def test_packing_plan_uses_complements():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 71, 20, 9, 55, 30, 8, 7]] = [5, 5, 3, 3, 3, 2, 2, 2, 2]
    fill, _ = filled(packing.plan_lengths(counts, 100))
    assert Counter(tuple(sorted(x for _, x in p)) for p in fill.values()) == {(40, 60): 5, (9, 20, 71): 3, (7, 8, 30, 55): 2}
    assert len(packing.plan_lengths(np.zeros(65, np.int64), 64)) == 0


def test_index_of_sums_follows_what_is_taken():
    rng = np.random.default_rng(3)
    avail = rng.integers(0, 3, 65)
    avail[0] = 0
    index = packing.Sums(avail.copy())
    for _ in range(40):
        have = np.flatnonzero(index.avail)
        if not len(have):
            break
        index.take({int(rng.choice(have)): 1}, 1)
        one = (index.avail > 0).astype(np.int64)
        two = np.convolve(one, one)[:65]
        assert (index.one == one).all() and (index.two == two).all() and (index.three == np.convolve(two, one)[:65]).all()


def test_packing_query(spark):
    paths = pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    d = docs(spark, [(1, None), (2, ""), (3, prose(rng, 9000)), (4, "a b"), (4, "a b")])
    got = packing.pack_documents(d, paths.path("word_bpe_49k.json")).collect()
    assert Counter(r.doc_id for r in got if r.length == 1) == {1: 1, 2: 1}
    own = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 3)
    assert [s for _, s, _ in own] == [4096 * i for i in range(len(own))] and all(n == 4096 for _, _, n in own[:-1])
    assert next(r.ids_crc32 for r in got if r.doc_id == 1) == zlib.crc32(struct.pack("<I", 1))
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(paths.path("word_bpe_49k.json"))
    for r in d.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(-(-len(ids) // 4096)):
            part = ids[4096 * k : 4096 * (k + 1)]
            assert any((x.doc_id, x.piece, x.length, x.ids_crc32) == (r.doc_id, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) for x in got)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 for v in used.values())
    assert packing.pack_documents(d.limit(0), paths.path("word_bpe_49k.json")).count() == 0


def test_dac_round_trip(spark):
    rng = np.random.default_rng(0)
    for top in (1, 255, 256, 65535, 1 << 24):
        ids = rng.integers(0, top + 1, 1500).astype(np.uint32)
        d = dac.Dac(dac.build(ids, np.array([0, 700])))
        assert d.all().tolist() == ids.tolist() and all(d[i] == ids[i] for i in range(0, 1500, 7)) and d.document(1).tolist() == ids[700:].tolist()
        places = rng.integers(0, 1500, 300)
        assert (d.at(places) == ids[places]).all() and all((d.between(a, b) == ids[a:b]).all() for a, b in np.sort(rng.integers(0, 1501, (40, 2))).tolist())
    assert len(dac.Dac(dac.build(np.zeros(0, np.uint32), np.zeros(0, np.int64)))) == 0
    paths, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(paths.path("byte_bpe_50k.json"))
    rows = [(5, "Hello world, it's\n\nme"), (1, None), (3, ""), (2, prose(random.Random(1), 3000))]
    start, want = 0, {}
    for i, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    manifest = dac.write_ids(docs(spark, rows), paths.path("byte_bpe_50k.json"))
    got = dac.read_ids(manifest).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    for r in manifest.collect():
        assert open(r.path.removeprefix("file://"), "rb").read(4) == dac.MAGIC
    rows += [(None, "last"), (None, None), (3, "again"), (3, "")]
    got = dac.read_ids(dac.write_ids(docs(spark, rows), paths.path("byte_bpe_50k.json"), file_bytes=4000)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 3, 3, 5, None, None] and [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got]))[:-1].tolist()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert dac.read_ids(dac.write_ids(docs(spark, rows).limit(0), paths.path("byte_bpe_50k.json"))).count() == 0


def test_flac_round_trip_and_checksums(spark):
    rng = np.random.default_rng(0)
    pads = [b" " * 192, b"abc" * 640, bytes(192), rng.integers(0, 256, 192 * 9).astype(np.uint8).tobytes(), (np.arange(192 * 5) // 7 % 256).astype(np.uint8).tobytes(), bytes([0, 255] * 96)]
    streams = flac.encode_streams(np.frombuffer(b"".join(pads), np.uint8), np.array([len(p) for p in pads]))
    for p, x in zip(pads, flac.decode_streams(streams), strict=True):
        assert (x.astype(np.int16) + 128).astype(np.uint8).tobytes() == p
    for at in (-1, -40, len(streams[3]) // 2):
        bad = bytearray(streams[3])
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(bad)])
    every = np.arange(256, dtype=np.uint8)
    assert (media.payload_of((media.samples_of(every).astype(np.int16) - 128).astype(np.int8)) == every).all()
    rows = awkward(1)
    got = media.media_features(media.pcm_blocks(media.encode_media(docs(spark, rows)), 2)).collect()
    assert len(got) == len(rows) and media.media_features(media.pcm_blocks(media.encode_media(docs(spark, rows).limit(0)))).count() == 0
    for r in got:
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and f"blocks={r.payload_bytes // 192};" in r.feature
    for i, t in rows:
        b = (t or "").encode()
        pay = b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
        assert any(r.doc_id == i and r.n_bytes == len(b) and r.payload_sha256 == hashlib.sha256(pay).hexdigest() and r.tail_crc32 == zlib.crc32(pay[-16:]) for r in got)
    blocks = media.pcm_blocks(media.encode_media(docs(spark, [(1, "x" * 7000)]))).orderBy("sample_offset").collect()
    assert [b.sample_offset for b in blocks] == [0, 3072, 6144] and sum(b.n_samples for b in blocks) == 7104
    for first, n in ((0, 5), (190, 4), (1000, 700), (1720, 9999), (1728, 1)):
        x = media.samples_at(streams[3], first, n)
        assert (x.astype(np.int16) + 128).astype(np.uint8).tobytes() == pads[3][first : first + n]


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<|esc|im_start|>", "<|esc|esc|nl|>", "<|nl|>", "a<|im_end|", "", "x\n", "<|im_end|>\n<|im_start|>assistant\nok"]
    for t in nasty:
        turns = [("user", t), ("assistant", t), ("odd\nrole<|im_end|>", t)]
        text, spans = chat.format_turns(turns)
        assert chat.parse(text) == turns and [chat.unescape(text[a:b]) for a, b in spans] == [t]
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (None, 0, "user", "n"), (1, 1, "assistant", "b"), (2, None, "user", "z" * 50_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.describe_formatted(chat.format_conversations(d)).collect()}
    assert got == {1: (3, 1), None: (1, 0), 2: (1, 0)}
    assert chat.describe_formatted(chat.format_conversations(d.limit(0))).count() == 0
    clash = d.selectExpr("*", "1 AS formatted", "'x' AS loss_spans", "2 AS n_turns")
    assert {r.conv_id: r.n_turns for r in chat.describe_formatted(chat.format_conversations(clash)).collect()} == {1: 3, None: 1, 2: 1}


def test_decontamination_recall_and_precision(spark):
    d, b = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [(r.item_id, decontaminate.item_words(r.text)) for r in b.collect()]
    want = set()
    for r in d.collect():
        w = decontaminate.item_words(r.text)
        for i, p in items:
            m = decontaminate.masks_of(p)
            if len(set(p) & set(w)) >= 0.6 * len(set(p)) and any(decontaminate.lcs(m, len(p), w[a : a + 2 * len(p) + 8]) >= 0.75 * len(p) for a in range(0, max(1, len(w) - len(p)), 8)):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(got) + 1


def test_decontamination_edges(spark):
    rng = random.Random(2)
    item = prose(rng, 30, 10_000)
    para = item.split()
    para[3:9] = ["other"] * 3
    d = docs(spark, [(1, prose(rng, 50) + " " + item.upper() + "! " + prose(rng, 20)), (2, " ".join(para)), (3, prose(rng, 200)), (4, None), (5, ""), (6, "say alpha beta now"), (7, item), (7, item)])
    b = spark.createDataFrame([(1, item), (2, "Alpha, beta."), (3, None), (4, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()} == {(1, 1), (2, 1), (6, 2), (7, 1)}
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0 and decontaminate.find_leaks(d, b.limit(0)).count() == 0


def near_copy(rng, text, share=0.12):
    w = text.split()
    for k in rng.sample(range(len(w)), round(share * len(w))):
        w[k] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def test_decontamination_finds_an_item_that_a_third_of_the_documents_leak(spark):
    rng = random.Random(6)
    items = [prose(rng, 40, 4000) for _ in range(40)]
    own = lambda n: prose(rng, n, 4000)
    rows = [(i, f"{own(60)} {near_copy(rng, items[0])} {own(40)}" if i % 3 == 0 else f"{own(60)} {near_copy(rng, items[7])}" if i % 50 == 1 else own(120)) for i in range(1200)]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), b).collect()}
    want = {(i, 0) for i in range(0, 1200, 3)} | {(i, 7) for i in range(1200) if i % 3 and i % 50 == 1}
    assert not got - want and len(got & want) >= 0.99 * len(want)


def test_decontamination_of_thousands_of_items_loses_no_near_copy(spark):
    rng = random.Random(8)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 6000)}"  # noqa: E731  common words and rare ones
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(44) for _ in range(3000)]
    rows, want = [], set()
    for i in range(500):
        k = rng.randrange(len(items))
        w, own = items[k].split(), decontaminate.item_words(items[k])
        for j in rng.sample(range(len(w)), 8):
            w[j] = f"w{rng.randrange(3000, 6000)}"
        rows.append((i, f"{text(50)} {' '.join(w)} {text(50)}"))
        if decontaminate.lcs(decontaminate.masks_of(own), len(own), w) >= decontaminate.NEAR * len(own):
            want.add((i, k))
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), b).collect()}
    assert len(want) > 400 and want <= got


def test_decontamination_finds_paraphrases(spark):
    """Recall against brute force: LCS of half to three quarters, and the answer, with words put in, left out and changed."""
    rng = random.Random(11)
    word = lambda: f"f{rng.randrange(25)}" if rng.random() < 0.4 else f"w{min(int(rng.paretovariate(0.35)), 8000)}"  # noqa: E731  function words and others
    text = lambda n: " ".join(word() for _ in range(n))
    items = [f"{text(30)}. {text(6)}." for _ in range(400)]
    rows, middle, near = [], set(), set()
    for i in range(600):
        k = rng.randrange(len(items))
        body, tail = items[k].split(". ")
        w = body.split()
        for j in rng.sample(range(len(w)), rng.randrange(10, 20)):
            w[j] = word() if rng.random() < 0.6 else "" if rng.random() < 0.5 else f"{w[j]} {word()}"
        copy = " ".join(w) + ". " + tail
        rows.append((i, f"{text(40)} {copy} {text(30)}"))
        own, other, answer = decontaminate.item_words(items[k]), decontaminate.item_words(copy), decontaminate.answer_of(items[k])
        share = decontaminate.lcs(decontaminate.masks_of(own), len(own), other) / len(own)
        if share >= 0.75:
            near.add((i, k))
        elif share >= 0.5 and decontaminate.lcs(decontaminate.masks_of(answer), len(answer), other) >= 0.8 * len(answer):
            middle.add((i, k))
    rows += [(1000 + i, text(150)) for i in range(300)]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), b).collect()}
    assert len(middle) > 300 and len(got & middle) >= 0.9 * len(middle) and near <= got and not [x for x in got if x[0] >= 1000]


def test_decontamination_repetitive_items_and_missing_ids(spark):
    rng = random.Random(13)
    again, plain = "alpha beta gamma " * 12, prose(rng, 30, 5000)
    rows = [(1, again), (2, prose(rng, 90) + " " + again), (None, plain), (None, prose(rng, 10) + " " + plain), (None, prose(rng, 60)), (3, "x " * 200_000 + plain)]
    b = spark.createDataFrame([(1, again), (2, plain), (None, "no such words here at all, none whatever, really none")], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, rows), b).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 2), (1, 1), (2, 1), (3, 2)]


def test_rarer_words_in_common_lose_no_leak():
    rng = np.random.default_rng(4)
    pieces = [(k, (rng.zipf(1.3, 40) % 300).tolist(), None, None) for k in range(60)]
    df = np.bincount(np.concatenate([p[1] for p in pieces]), minlength=300)
    first, owners, need, near = decontaminate.postings(pieces, np.zeros(60, bool), df)
    tok = np.concatenate([np.where(rng.random(40) < 0.55, pieces[rng.integers(60)][1], rng.integers(0, 300, 40)) for _ in range(200)])
    where = np.arange(len(tok)) // decontaminate.STEP
    chunks = int(where[-1]) + 1
    low, high = np.zeros(chunks, np.int64), np.full(chunks, chunks - 3)
    got = set(zip(*(x.tolist() for x in decontaminate.shared_words(first, owners, need, tok, where, low, high)[:2]), strict=True))
    for w in range(chunks - 2):
        own = tok[where >= w][: decontaminate.WINDOW].tolist()
        for k, ids, _, _ in pieces:
            if decontaminate.lcs(decontaminate.masks_of(ids), len(ids), own) >= 0.5 * len(ids):
                assert (w, k) in got


def test_queries_equal_sql(spark, oracle):
    from veristrata.llm.queries import QUERIES, SQL

    con, folder = oracle
    for name, sql in SQL.items():
        assert canon(QUERIES[name](spark, folder).toPandas()) == canon(con.sql(sql).df()), name


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect() if r.text and any(c.isalpha() for c in r.text)]
    kept = {i for i, _, c in brute_components(rows) if i == c}
    at = p.near_duplicates(spark, p.language(spark, d, FOLDER), FOLDER)
    assert {r.doc_id for r in at.collect()} == kept and at.columns == p.COLUMNS
    rows = sorted((i, t) for i, t in rows if i in kept)
    words = [(i, t.split()) for i, t in rows]
    gone = {i: g for (i, _), g in zip(words, brute_spans(words, 50), strict=True)}
    left = {i: (t if not any(gone[i]) else " ".join(w for w, g in zip(t.split(), gone[i], strict=True) if not g)) for i, t in rows if not all(gone[i])}
    at = p.repeated_passages(spark, at, FOLDER)
    assert {r.doc_id: r.text for r in at.collect()} == left and at.columns == p.COLUMNS
    at = p.leaked_benchmarks(spark, at, FOLDER)
    clean = {r.doc_id for r in at.collect()}
    assert clean <= set(left) and len(clean) >= 0.8 * len(left)
    done = p.run(spark, FOLDER).collect()
    assert {r.doc_id for r in done} == clean
    tok, text = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")), {r.doc_id: r.text for r in at.collect()}
    lengths, places = Counter(), {}
    for r in done:
        lengths[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert lengths == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in text.items()}
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_pipeline_without_ids_and_with_extra_columns(spark):
    import corpus_pipeline as p

    rng = random.Random(12)
    copy, clean, part = prose(rng, 90), prose(rng, 80), prose(rng, 60)
    rows = [(None, copy), (None, copy), (1, copy), (2, copy), (None, clean), (None, clean), (None, None), (5, None), (6, part + " " + prose(rng, 30)), (None, prose(rng, 30) + " " + part)]
    d = spark.createDataFrame([(i, t, "en", "s", 1, 0, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, own long, component_id long, kept string")
    bare = d.select(*p.COLUMNS)
    for stage in (p.language, p.near_duplicates, p.repeated_passages, p.leaked_benchmarks):
        assert stage(spark, d, FOLDER).columns == p.COLUMNS and stage(spark, bare.limit(0), FOLDER).count() == 0
    assert Counter((r.doc_id, r.text) for r in p.near_duplicates(spark, bare.where("text is not null"), FOLDER).collect()) == Counter([(1, copy), (None, clean), rows[-2], rows[-1]])
    left = [r.text for r in p.repeated_passages(spark, bare.where("doc_id is null or doc_id = 6"), FOLDER).collect() if r.doc_id is None and r.text]
    assert Counter(len(t.split()) for t in left) == Counter([90, 80, 30])
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    leaky = spark.createDataFrame([(None, item, "en", "s", 1), (None, clean, "en", "s", 1), (3, item, "en", "s", 1), (4, clean, "en", "s", 1)], bare.schema)
    assert Counter((r.doc_id, r.text) for r in p.leaked_benchmarks(spark, leaky, FOLDER).collect()) == Counter([(None, clean), (4, clean)])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
