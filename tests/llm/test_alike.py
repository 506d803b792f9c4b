"""Results that must not depend on spelling of blanks, scripts, repeats, or how rows are dealt out."""

import random

import numpy as np
import pytest

from tests.llm.test_llm import docs, prose
from veristrata.llm import decontaminate, langid, lm


def leaks(spark, rows, items):
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows), b).collect()}


def test_exact_copies_in_any_script(spark):
    rng = random.Random(11)
    greek = "ΟΙ ΝΟΜΟΙ ΤΗΣ ΠΟΛΕΩΣ ΚΑΙ ΟΙ ΠΟΛΙΤΕΣ ΤΟΥΣ ΣΕΒΟΝΤΑΙ ΟΛΟΙ ΑΝΤΑΜΑ ΚΑΘΕ ΗΜΕΡΑ"
    thin = "which river flows past the old mill　and into the wide grey sea at dawn"
    chinese = "长江是亚洲第一长河流经十一个省份最后注入东海它的源头在青藏高原"
    thai = "แม่น้ำเจ้าพระยาไหลผ่านกรุงเทพมหานครและลงสู่อ่าวไทย"
    items = [thin, greek, chinese, thai, "short 东海 item"]
    noise = lambda: prose(rng, 60)
    rows = [
        (1, noise() + " " + thin + " " + noise()), (2, noise() + " " + thin.replace(" ", " ").replace(" ", " ") + " " + noise()),
        (3, noise() + " " + greek + " " + noise()), (4, noise() + " " + greek.lower().replace("ς", "σ") + " " + noise()), (5, "天气很好我们去公园散步看见很多花。" + chinese + "，然后回家吃饭睡觉。"), (6, "ก่อนอื่น" + thai + "และอื่นๆ"),
        (7, noise() + "：short东海item。" + noise()), (8, "天气很好我们去公园散步看见很多花，然后回家吃饭睡觉。"), (9, noise()),
    ]
    assert leaks(spark, rows, items) == {(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 3), (7, 4)}


@pytest.mark.parametrize("text", ["a\u0085b c d e f　g", "é ß «word»—x", "漢字かな kana, abc漢", " ", "", "𠀋𠀌x", "plain words only."])
def test_words_of_items_and_documents_are_alike(text):
    own = decontaminate.item_words(text)
    import pyarrow as pa

    raw = np.frombuffer(("left " + text + " right").encode(), np.uint8)
    vocab = sorted({*own, "left", "right"})
    t = decontaminate.Tokens(raw, np.array([0, len(raw)]), pa.array(vocab, pa.string()))
    assert [vocab[i] for i in t.ids] == ["left", *own, "right"]
    blanks = "".join(" " if c.isspace() else c for c in text)
    if not any(ord(c) > 0x2E7F for c in text):
        assert [w.strip(decontaminate.PUNCTUATION) for w in blanks.lower().split() if w.strip(decontaminate.PUNCTUATION)] == own


def test_langid_sample_is_of_different_texts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "the same text again and again") for i in range(2000)] + [(3000 + i, "".join(rng.choice("abcdefgh ") for _ in range(90))) for i in range(50)]
    got = {}
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda labels, x: got.update(n=len(labels), kinds=len({r.tobytes() for r in x})) or fit(labels, x))
    langid.train_language_model(docs(spark, rows).repartition(5))
    assert got == {"n": 51, "kinds": 51}


def plain_shares(text):
    """The shares of hashed bigrams and trigrams, one by one."""
    raw, n = [int(langid._FOLD[b]) for b in text.encode()], [0] * langid.DIMS
    for i in range(len(raw) - 1):
        n[(((raw[i] << 8 | raw[i + 1]) * 40503) >> 4) % langid._BIGRAMS] += 1
    for i in range(len(raw) - 2):
        n[langid._BIGRAMS + (((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) >> 13) % (langid.DIMS - langid._BIGRAMS)] += 1
    return [x / max(1, sum(n)) for x in n]


def test_langid_predictions_equal_a_plain_version(spark):
    """Family by the largest of its machine's values, then votes of pairs, text by text."""
    rng = random.Random(4)
    words = {"en": "the of and to in that was with for his", "fr": "le la les des une dans pour que avec sur", "es": "el los las del que una por con para como", "de": "der die und das mit von auf ist nicht eine"}
    rows = [(i, " ".join(rng.choice(words[c].split()) for _ in range(rng.randrange(3, 60))), c) for i in range(240) for c in [list(words)[i % 4]]]
    d = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 --", "en"), (902, "x", None)], "doc_id long, text string, lang string")
    model = langid.train_language_model(d)
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(d, model).collect()}
    families = model.families
    for i, t, _ in rows:
        value = np.array([*plain_shares(t), 1.0]) @ model.weights.astype(np.float64)
        best = int(np.argmax(value[: len(families)]))
        own = [k for k, c in enumerate(model.langs) if families.index(langid.family_of(c)) == best]
        votes = dict.fromkeys(own, 0.0)
        for (a, b), v in zip(model.pairs, value[len(families) :], strict=True):
            if a in votes and b in votes:
                votes[a if v > 0 else b] += 1
        assert got[i] in [model.langs[k] for k in own if votes[k] == max(votes.values())]
    assert got[900] == got[901] == "und" and got[902] in words
    right = sum(got[i] == c for i, _, c in rows)
    assert right >= 0.97 * len(rows)


def test_lm_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(40, 400), 900 if i % 3 else 60)) for i in range(240)]
    got = []
    for parts in (1, 16, 60):
        got.append({r.doc_id: r.score for r in lm.score_texts(docs(spark, rows).repartition(parts)).collect()})
    for other in got[1:]:
        assert max(abs(other[i] - got[0][i]) for i in got[0]) < 1e-6 * max(1, max(abs(v) for v in got[0].values()))


def test_the_largest_id_is_no_null(spark):
    import public_tokenizers

    from veristrata.llm import dac, jaccard, media, packing, substring, suffix

    last = 2**63 - 1
    d = docs(spark, [(last, "one two three four five six"), (None, "one two three four five six"), (3, "seven eight"), (last, None)])
    want = sorted([last, last, 3, None], key=str)
    ids = lambda t: sorted((r.doc_id for r in t.select("doc_id").collect()), key=str)
    assert ids(lm.score_texts(d)) == want
    assert ids(langid.predict_languages(d, None)) == want
    assert ids(packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json"))) == want
    assert ids(substring.dedup_words(d, texts=False)) == want
    assert ids(jaccard.jaccard_components(d)) == want
    assert ids(media.encode_media(d)) == want
    assert ids(suffix.dedup_bytes(d, texts=False)) == want
    assert ids(dac.read_ids(dac.write_ids(d, public_tokenizers.path("byte_bpe_50k.json")))) == want


def test_token_files_order_rows_of_one_id(spark):
    import public_tokenizers

    from veristrata.llm import dac

    rows = [(7, f"text number {i}") for i in range(40)] + [(1, "first"), (9, "last"), (None, "nameless"), (7, "text number 3")]
    seen = []
    for parts in (1, 5):
        got = dac.read_ids(dac.write_ids(docs(spark, rows).repartition(parts), public_tokenizers.path("byte_bpe_50k.json"))).collect()
        seen.append(sorted((r.start, str(r.doc_id), r.ids_crc32) for r in got))
        assert [r[1] for r in seen[-1]] == ["1"] + ["7"] * 41 + ["9", "None"]
    assert seen[0] == seen[1]


def test_empty_tables(spark):
    from veristrata.llm import jaccard, substring, suffix

    d = docs(spark, [(1, "x")]).limit(0)
    assert substring.dedup_words(d, texts=False).count() == jaccard.jaccard_components(d).count() == suffix.dedup_bytes(d, texts=False).count() == 0


def test_blocks_of_items_share_a_scan(spark, monkeypatch, tmp_path):
    rng = random.Random(21)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    items = [letters(rng.randrange(5, 90)) for _ in range(40)]
    rows = [(i, letters(50) + " " + items[i % 40] + " " + letters(50)) for i in range(60)] + [(100 + i, letters(120)) for i in range(30)]
    want = {(i, i % 40) for i in range(60)}
    docs(spark, rows).write.parquet(f"{tmp_path}/d")
    d, b = spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    surveys = []
    survey = decontaminate.survey
    monkeypatch.setattr(decontaminate, "survey", lambda *a: surveys.append(1) or survey(*a))
    found = decontaminate.find_leaks(d, b)
    assert len(surveys) == 1 and found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    monkeypatch.setattr(decontaminate, "TOGETHER", 3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()} == want and len(surveys) > 2


def test_the_latent_space_is_fitted_on_every_passage(spark):
    """More passages than any sample of 256 a task: each word of the corpus is in them as often as in its texts."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 500}" for k in range(150)) + (" rare" if i == 1777 else "")) for i in range(2000)]
    vocab = [f"w{k}" for k in range(500)] + ["rare"]
    df, n, passages = decontaminate.survey(docs(spark, rows).select("text").repartition(3), vocab)
    got = [0] * 501
    some = passages.collect()
    for r in some:
        assert sum(r["size"]) == len(r["at"]) == len(r["tf"]) and all(r["size"])
        for at, tf in zip(r["at"], r["tf"], strict=True):
            got[at] += tf
    assert n == 2000 and sum(len(r["size"]) for r in some) == 3 * 2000 and got == [sum(t.split().count(w) for _, t in rows) for w in vocab] and df[500] == 1


def test_langid_learns_from_every_text(spark, monkeypatch):
    """All different texts, at hand or in stored blocks: no bound on texts of a language, and the same machines both ways."""
    rng = random.Random(15)
    words = {"en": "the of and to in that was with for his", "de": "der die und das mit von auf ist nicht eine", "fr": "le la les des une dans pour que avec sur"}
    rows = [(i, " ".join(rng.choice(words[c].split()) for _ in range(rng.randrange(6, 30))), c) for i in range(1500) for c in [list(words)[i % 3]]]
    rows += [(9000 + i, "the same text again", "en") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    different = sorted({(c, t) for _, t, c in rows})
    want = langid.fit([c for c, _ in different], np.concatenate([langid.shares(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for _, t in different]))
    for local in (3000, 100):
        monkeypatch.setattr(langid, "LOCAL", local, raising=False)
        monkeypatch.setattr(langid, "TASK", 400, raising=False)
        got = langid.train_language_model(d)
        assert (got.langs, got.families, got.pairs) == (want.langs, want.families, want.pairs)
        assert np.abs(got.weights - want.weights).max() < 1e-3 * np.abs(want.weights).max()


def test_products_of_passages_equal_plain_ones(monkeypatch):
    """Common and rare words, passages without any, blocks of all common or all rare ones."""
    rng = np.random.default_rng(8)
    for n, dims, share in ((300, 900, 0.04), (300, 900, 0.0), (300, 900, 1.0), (1, 5, 0.04), (2, 5, 0.5)):
        monkeypatch.setattr(decontaminate, "DENSE", share)
        a = rng.random((n, dims)).astype(np.float32) * (rng.random((n, dims)) < 0.5 / (1 + np.arange(dims) / 4))
        a[n // 2] = 0
        v = rng.standard_normal((dims, 16)).astype(np.float32)
        row, at = np.nonzero(a)
        z = np.ones((dims, 16))
        decontaminate.add_product(z, v, np.bincount(row, minlength=n), at, a[row, at])
        assert np.allclose(z, 1 + a.astype(np.float64).T @ (a.astype(np.float64) @ v), rtol=1e-3, atol=1e-3)
