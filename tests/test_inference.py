"""Resampling, nulls, claim building, gates and files against brute force or what can be known by hand."""

import json
import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata import config as C
from veristrata.functions import columns as K
from veristrata.operators import decoy, gates, graph, registry, resample, sequence, stats
from veristrata.plans.ledger import class_decoy_ledger
from veristrata.sources import claims as S
from veristrata.sources import readers, sinks

CELLS = "cluster string, stratum long, n long, k1 long, n1 long, k0 long, n0 long"


def test_bootstrap_is_brute_force_for_any_number_of_blocks(spark):
    rng = random.Random(1)
    rows = []
    for c in range(17):
        for s in range(3):
            n1, n0 = rng.randrange(1, 9), rng.randrange(1, 9)
            rows.append((f"g{c:02d}", s, n1 + n0, rng.randrange(n1 + 1), n1, rng.randrange(n0 + 1), n0))
    cells = spark.createDataFrame(rows, CELLS)
    names = sorted({r[0] for r in rows})
    weight = {s: sum(r[2] for r in rows if r[1] == s) for s in range(3)}
    want = {}
    for r in range(40):
        times = Counter(names[i] for i in resample.lcg_draws(7, r * len(names), len(names), len(names)))
        sums = {s: [sum(times[x[0]] * x[i] for x in rows if x[1] == s) for i in (3, 4, 5, 6)] for s in range(3)}
        p1 = sum(weight[s] * k1 / n1 for s, (k1, n1, _, n0) in sums.items() if n1 and n0)
        p0 = sum(weight[s] * k0 / n0 for s, (_, n1, k0, n0) in sums.items() if n1 and n0)
        want[r] = p1 / p0 if p0 else math.nan
    for block in (50, 4):
        got = {r.replicate: r.rr for r in resample.clustered_bootstrap(cells, spark, 40, 7, block).collect()}
        assert set(got) == set(want) and all(math.isclose(got[r], want[r], rel_tol=1e-9) or (math.isnan(got[r]) and math.isnan(want[r])) for r in want)
    assert resample.clustered_bootstrap(cells.limit(0), spark, 5).count() == 0


def test_permutation_null_is_exact_in_distribution(spark):
    rows = [(1, "a", "x", "x"), (2, "a", "x", "y"), (3, "a", "y", "y"), (4, "a", "z", "x"), (5, "b", "u", "u"), (6, "b", "v", "u"), (7, "c", "w", "w")]
    hits = spark.createDataFrame(rows, "item long, stratum string, label string, target string")
    got = resample.permutation_null(spark, hits, 4000, 3).first()
    null = []
    for p in permutations(["x", "x", "y", "z"]):
        for q in permutations(["u", "v"]):
            null.append(sum(a == b for a, b in zip(p, ["x", "y", "y", "x"], strict=True)) + sum(a == b for a, b in zip(q, ["u", "u"], strict=True)) + 1)
    assert got.observed == 2 + 1 + 1 and got.permutable == 2
    assert abs(got.null_mean - np.mean(null)) < 0.06 and abs(got.p - np.mean([x >= 4 for x in null])) < 0.04


def test_both_ways_of_permuting_agree():
    labels, targets = np.array([30, 20, 10]), np.array([10, 25, 25])
    by_margins = [resample.permuted_hits(np.random.default_rng([1, r]), labels, targets) for r in range(3000)]
    rng = np.random.default_rng(2)
    a, b = np.repeat(np.arange(3), labels), np.repeat(np.arange(3), targets)
    by_items = [int((rng.permutation(a) == b).sum()) for _ in range(3000)]
    assert abs(np.mean(by_margins) - np.mean(by_items)) < 0.3 and abs(np.std(by_margins) - np.std(by_items)) < 0.2


def test_placebo_deals_rows_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), float(rng.integers(6))) for _ in range(120)]
    pool = [0] * 5 + [1] * 3 + [2] * 4
    t = spark.createDataFrame(rows, "len long, breadth double")
    got = np.array([r.difference for r in resample.placebo(t, spark.createDataFrame([(b,) for b in pool], "bin int"), 300, 1).collect()])
    want = []
    for _ in range(2000):
        bins = rng.choice(pool, len(rows))
        mean = {}
        for b in (0, 2):
            top = low = 0.0
            for s in range(3):
                own = [v for (x, v), k in zip(rows, bins, strict=True) if x == s and k == b]
                w = sum(x == s for x, _ in rows)
                if own:
                    top, low = top + w * np.mean(own), low + w
            mean[b] = top / low
        want.append(mean[2] - mean[0])
    assert len(got) == 300 and abs(got.mean() - np.mean(want)) < 0.08 and abs(got.std() - np.std(want)) < 0.06


def test_decoy_swap(spark):
    items = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "lonely")], "item long, parent string")
    hits = spark.createDataFrame([(1, "p"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, "lonely")], "item long, gene string")
    family = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "z"), ("q", "c"), ("q", "c")], "parent string, gene string")
    got = resample.decoy_swap(items, hits, family, 3000, 0).first()
    assert (got.n, got.observed, got.null_max) == (3, 1, 3) and abs(got.null_mean - (1 / 3 + 2 / 3 + 1)) < 0.05 and got.p == 1.0


def test_nulls_keep_letters_and_lengths(spark):
    t = spark.createDataFrame([("ABCDEFGH",), ("AABB",), ("",), (None,), ("AABB",)], "s string")
    one = [r.x for r in t.select(resample.shuffled(F.col("s"), 3).alias("x")).collect()]
    many = [r.x for r in t.repartition(5).select("s", resample.shuffled(F.col("s"), 3).alias("x")).collect()]
    assert sorted(one[0]) == list("ABCDEFGH") and one[0] != "ABCDEFGH" and sorted(one[1]) == list("AABB") and one[1] == one[4]
    assert sorted(map(str, one)) == sorted(map(str, many))
    weights = resample.letter_weights(t.where("s <> ''"), "s")
    assert weights == {"A": 5, "B": 5, "C": 1, "D": 1, "E": 1, "F": 1, "G": 1, "H": 1}
    long = spark.range(400).select(F.concat(F.lit("S" * 20), F.col("id").cast("string")).alias("s"))
    made = [r.x for r in long.select(resample.uniform(F.col("s"), 1, {"A": 3, "B": 1}).alias("x"), "s").collect()]
    n = Counter("".join(made))
    assert set(n) == {"A", "B"} and abs(n["A"] / sum(n.values()) - 0.75) < 0.02 and all(20 < len(x) < 24 for x in made)


def test_effective_rho(spark):
    t = spark.createDataFrame([(900, 100)] + [(1, 9)] * 100, "n long, c long")
    for a, b, want in (("n", "c", 0.213), ("c", "n", 4.69)):
        assert abs(resample.effective_rho(t, a, b, 0.01).first().rho_eff - want) < 0.01 * max(1, want)
    r = resample.simulated_rho(t, "n", "c", 0.01, 20_000, 0).first()
    assert abs(r.dn / r.dc - resample.effective_rho(t, "n", "c", 0.01).first().rho_eff) < 0.01


def test_seeds_find_what_contains_finds(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ABC") for _ in range(n))
    refs = [(i, f"g{i % 3}", text(rng.randrange(0, 900))) for i in range(25)] + [(98, "g0", None), (99, None, text(50))]
    seqs = sorted({t[a : a + rng.randrange(4, 40)] for _, _, t in refs[:20] if len(t or "") > 60 for a in (0, 17, len(t) - 30)} | {text(9) for _ in range(20)})
    q = [(s, f"g{k % 4}") for k, s in enumerate(seqs)] + [("", "g0"), (None, "g1"), (seqs[0], None)]
    r, queries = spark.createDataFrame(refs, "id long, gene string, text string"), spark.createDataFrame(q, "seq string, gene string")
    want = {(s, i) for s in seqs for i, _, t in refs if t and len(s) >= 4 and s in t}
    own = {(s, g): any(t and h == g and s in t for _, h, t in refs) for s, g in q if s and g}
    for held in (sequence.HELD_BYTES, 0):
        monkeypatch.setattr(sequence, "HELD_BYTES", held)
        monkeypatch.setattr(sequence, "SEGMENT", 64)
        assert {tuple(x) for x in sequence.seed_matches(queries.select("seq"), r, ["id"], 4).collect()} == want
        got = {(x.seq, x.gene): x.own for x in sequence.in_own_group(queries, r, "gene").collect() if x.seq and x.gene}
        assert got == own
        long = queries.where("length(seq) >= 11")
        assert {tuple(x) for x in sequence.seed_matches(long, r, ["id"], 4).collect()} == {(s, i) for s, i in want if len(s) >= 11}
    monkeypatch.setattr(sequence, "LENGTHS", 2)
    assert {x.seq for x in sequence.contained(queries, r).collect()} == {s for s in seqs if any(t and s in t for _, _, t in refs)}
    assert {tuple(x) for x in sequence.matches(queries.where("seq <> ''"), r, ["id"]).collect()} == {(s, i) for s in seqs for i, _, t in refs if t and s in t}
    assert sequence.seed_matches(queries.limit(0), r, ["id"], 4).count() == 0


def test_self_fraction_gene_level_and_frames(spark):
    psms = spark.createDataFrame([("novel", "abc", False), ("novel", "ABC", False), ("novel", "zzz", False), ("novel", "bcd", True), ("canonical", "abc", False), ("novel", None, False), ("other", "", False)], "class string, peptide string, is_decoy boolean")
    refs = spark.createDataFrame([("xxABCDxx",)], "text string")
    assert [tuple(r) for r in sequence.self_fraction(psms, refs).collect()] == [("novel", 2, 1, 0.5)]
    found = spark.createDataFrame([("s1", "g1", True, True), ("s2", "g1", False, True), ("s3", "g2", False, False), ("s4", None, False, True)], "seq string, gene string, own boolean, is_self boolean")
    assert tuple(sequence.gene_level(found.where("is_self and gene is not null"), "gene").first()) == (1, 1)
    audit = {r.is_self: (r.n, r.coding, r.own) for r in sequence.frame_audit(found, spark.createDataFrame([("g1",)], "gene string"), "gene", "is_self").collect()}
    assert audit == {True: (3, 2, 1), False: (1, 0, 0)}


@pytest.mark.parametrize("by", [None, ["sample"]])
def test_q_sweep_with_common_scores(spark, by):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1.0, 1.0, 1.0, 2.0, 2.5, rng.random() * 3]), rng.random() < 0.3, rng.choice("abb")) for i in range(400)]
    t = spark.createDataFrame(rows, "i long, score double, is_decoy boolean, sample string")
    want = {}
    for s in "ab" if by else ["ab"]:
        own = sorted([r for r in rows if r[1] is not None and r[3] in s], key=lambda r: (-r[1], r[0]))
        d = n = 0
        rates = []
        for r in own:
            d, n = d + r[2], n + (not r[2])
            rates.append(d / max(n, 1))
        least = 1.0
        for r, x in zip(own[::-1], rates[::-1], strict=True):
            least = min(least, x)
            want[r[0]] = least
    got = {r.i: r.q for r in decoy.q_sweep(t, "score", "is_decoy", "i", by=by, buckets=7).collect()}
    assert all((got[r[0]] is None) if r[1] is None else math.isclose(got[r[0]], want[r[0]]) for r in rows)


def test_small_reports(spark):
    t = spark.createDataFrame([(1, 3.0), (2, 4.0), (3, 4.0), (4, 2.0)], "bin int, mean double")
    assert tuple(stats.monotone(t, "bin", "mean").first()) == (3, 1, False) and tuple(stats.monotone(t.limit(0), "bin", "mean").first()) == (0, 0, True)
    assert stats.last_minus_first(t, "bin", "mean").first().difference == -1.0
    assert [r.bin for r in stats.top_k(t, 2, [F.desc("mean"), F.col("bin")]).collect()] == [2, 3]
    assert sinks.bars(t.orderBy("bin"), "bin", "mean", 4).splitlines()[1].endswith("####")
    with pytest.raises(ValueError):
        sinks.bars(t, "bin", "mean", most=2)
    items = spark.createDataFrame([("e1", "g1"), ("e2", "g1"), ("e3", "g9"), (None, None)], "entry string, gene string")
    links = spark.createDataFrame([("e1", "i1"), ("e1", "i2"), ("e2", "i9")], "entry string, ident string")
    got = registry.linked_value(items, links, spark.createDataFrame([("i1", 3.0), ("i2", 5.0)], "ident string, ppm double"), spark.createDataFrame([("g1", 1.0)], "gene string, ppm double"), "entry", "ident", "gene", "ppm")
    assert {r.entry: (r.ppm, r.via) for r in got.collect()} == {"e1": (5.0, "link"), "e2": (1.0, "gene"), "e3": (None, None), None: (None, None)}


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(None, 5), (7, None), (9, 9)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)}


def test_positional_honours_quotes(spark, tmp_path):
    (tmp_path / "x.csv").write_text('head\n"a, b",c,d\nx,"say ""hi""",\n"",b,c\nshort\nplain,text,here\n')
    got = [tuple(r)[1:] for r in readers.positional(spark, str(tmp_path / "x.csv"), 3, 3, ",").orderBy("_row_idx").collect()]
    assert got == [("a, b", "c", "d"), ("x", 'say "hi"', ""), ("", "b", "c"), ("plain", "text", "here")]


def test_expanded_claims_and_their_gate(spark):
    genes = spark.createDataFrame([(2, "MAGEA4", "protein_coding", "ABCDEFG, (x) HIJKLMNO;short;ABC1DEFG"), (3, "XP1", "processed_pseudogene", ""), (4, "GEN", "lincRNA", "ABCDEFG(Oxidation),ABCDEFG")], "_row long, gene string, biotype string, cell string")
    best = spark.createDataFrame([("ABCDEFG", 0.001)], "peptide string, q double")
    t = S.expand_genes(genes, {"citation_location": "Table S"}, "cohort:x", best_q=best)
    rows = sorted((r._source_row, r._pep_index, r.peptide_sequence, r.orf_class, r.antigen_type, r.psm_qvalue, r._claim_unit) for r in t.collect())
    nr = C.NOT_REPORTED
    assert rows == [("2", 0, "ABCDEFG", "other", "TAA", "0.001", "peptide-source-claim"), ("2", 1, "HIJKLMNO", "other", "TAA", nr, "peptide-source-claim"), ("3", 0, nr, "pseudogene-ORF", "TSA", nr, "gene-level"),
                    ("4", 0, "ABCDEFG", "lncRNA-ORF", "TSA", "0.001", "peptide-source-claim"), ("4", 1, "ABCDEFG", "lncRNA-ORF", "TSA", "0.001", "peptide-source-claim")]
    figures = S.expansion(t)
    gates.expansion_holds(figures)
    assert (figures.first().unique_peptides, figures.first().duplicates) == (2, 1)
    with pytest.raises(gates.GateError):
        gates.expansion_holds(S.expansion(t.where("_pep_index = 0")))


def test_prose(spark):
    text = "# Title\nWe found 41.5 % of them.\nIt is proven beyond doubt.\nWe do not claim it is proven beyond doubt.\n## What this does not claim\n- a cure\n## End\nA CURE is near.\n"
    t = spark.createDataFrame([(text,)], "value string")
    got = {(r.problem, r.phrase): r.n for r in gates.prose_problems(t, ["41.5 %", "12 samples"], ["proven beyond doubt", "a cure", "never said"], "do not claim", "What this does not claim").collect()}
    assert got == {("missing", "12 samples"): 1, ("asserted", "proven beyond doubt"): 1, ("asserted", "a cure"): 1}
    assert gates.numbers_hold(t, {"share": "41.5 %", "samples": "99"}) == ["samples"]


def test_only_evidence_compares_evidence_fields():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "veristrata"
    assert gates.one_reader_of(["psm_qvalue", "reported_fdr", "periodicity_pct", "tumor_specificity_result"], root, {"evidence.py", "ladder.py"}) == []


def test_ledger_from_a_file(spark, tmp_path):
    rows = ["PSMId\tpeptide\tProteins\tscore"] + [f"s{i}\tPEPTIDE{'ABCDE'[i % 5]}\t{'rev_' if i in (6, 9) else ''}{['sp|P1', 'orf2', 'ENSP3'][i % 3]}\t{100 - i}" for i in range(10)]
    (tmp_path / "psms.tsv").write_text("\n".join(rows) + "\n")
    (tmp_path / "canon.fasta").write_text(">sp|P1|X_H\nMMPEPT\nIDEBMM\n")
    out = str(tmp_path / "out")
    said = class_decoy_ledger(spark, str(tmp_path / "psms.tsv"), out, score="score", alpha=0.2, canonical=str(tmp_path / "canon.fasta"), strata=True, emit_contract=True)
    assert {r["class"]: (r["n_target"], r["n_decoy"]) for r in said["ledger"]} == {"canonical": (2, 1), "noncanonical": (3, 0), "variant": (3, 0)}
    assert [(r["class"], r["n_target_peptides"], r["canonical_self"]) for r in said["canonical_self"]] == [("noncanonical", 3, 1)]
    assert json.loads(spark.read.text(out + ".json").first().value) == said and said["meta"]["input_sha256"].keys() == {"psms.tsv"}
    table = spark.read.csv(out + ".tsv", header=True, sep="\t").collect()
    assert len(table) == 3 and all(r.analysis_id == "psms.tsv" and r.all_target == "8" for r in table)
    contract = spark.read.csv(out + ".psms.csv", header=True).collect()
    assert len(contract) == 10 and sum(r.accession.startswith("rev_") and r.is_decoy == "1" for r in contract) == 2
    assert class_decoy_ledger(spark, "psms.tsv", out, score="score", alpha=0.2, base=str(tmp_path))["ledger"] == said["ledger"]
    with pytest.raises(FileNotFoundError):
        class_decoy_ledger(spark, "no.tsv", out, score="score", base=str(tmp_path))
    for bad in ({"alpha": 0}, {"unit": "spectrum"}, {"q": "missing"}, {"columns": {"peptide": "nope"}}):
        with pytest.raises(ValueError):
            class_decoy_ledger(spark, str(tmp_path / "psms.tsv"), out, **({"score": "score"} | bad))
    (tmp_path / "none.tsv").write_text(rows[0] + "\n")
    with pytest.raises(gates.GateError):
        class_decoy_ledger(spark, str(tmp_path / "none.tsv"), out, score="score")


def test_controls_and_labels(spark):
    t = spark.createDataFrame([("MAGEA3", "protein_coding"), ("MAGEA3-AS1", "x"), ("CTCFL", "lincRNA"), ("SAGE1", None), (None, None)], "g string, b string")
    assert [r[0] for r in t.select(K.is_control(F.col("g"), F.col("b"))).collect()] == [True, False, False, True, False]


def test_queries_beyond_what_a_task_holds_send_only_what_is_found(spark, monkeypatch, tmp_path):
    """What is shuffled follows what is found, not the references: their seeds are many times their text."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ABCDEÉ語") for _ in range(n))
    refs = [(i, i % 3, text(rng.choice([0, 5, 700]))) for i in range(60)] + [(60, 1, None)]
    seqs = sorted({t[a : a + n] for _, _, t in refs[:30] if len(t or "") > 600 for a, n in ((3, 12), (100, 6), (688, 12), (694, 6))} | {text(12) for _ in range(9)} | {t[-3:] + u[:9] for (_, _, t), (_, _, u) in zip(refs, refs[1:-1], strict=False) if t and u})
    q, r = spark.createDataFrame([(s,) for s in seqs], "seq string"), spark.createDataFrame(refs, "id long, gene long, text string")
    monkeypatch.setattr(sequence, "HELD_BYTES", 0)
    found = sequence.seed_matches(q, r, ["gene"], 6)
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, g) for s in seqs if len(s) >= 6 for _, g, t in refs if t and s in t}
    found.write.parquet(f"{tmp_path}/out")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and len(got) < 200
