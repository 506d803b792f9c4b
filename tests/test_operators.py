import math
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from veristrata import config as C
from veristrata.functions import columns as K
from veristrata.operators import decoy, gates, graph, ladder, registry, resample, sequence, stats
from veristrata.sources import readers, sinks

PSMS = """PSMId\tis_decoy\tq\tpeptide\tProteins
a1\t0\t0.001\tAAAK\tsp|P1|A
a2\t0\t0.002\tBBBK\tsp|P2|B
a3\t0\t0.005\tCCCK\tsp|P3|C
a4\t1\t0.008\tDDDK\trev_sp|P4|D
b1\t0\t0.001\tEEEK\torf1
b2\t0\t0.003\tFFFK\torf2
b3\t0\t0.009\tGGGK\torf3
b4\t1\t0.007\tHHHK\trev_orf4
c1\t0\t0.004\tIIIK\tENSP1-Mut
x1\t0\t0.050\tJJJK\torf5
x2\ttrue\t0.040\tKKKK\trev_sp|P9|X
x3\t0\t0.020\tLLLK\tsp|P8|Y
"""


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture
def psms(spark, tmp_path):
    p = tmp_path / "psms.tsv"
    p.write_text(PSMS)
    return readers.psm_tsv(spark, str(p), q="q")


def test_ledger_by_hand(psms):
    got = {r["class"]: (r["n_target"], r["n_decoy"]) for r in rows(decoy.ledger(decoy.accepted(psms, 0.01)))}
    assert got == {"canonical": (3, 1), "noncanonical": (3, 1), "variant": (1, 0)}
    assert decoy.contract(psms).count() == 12 and decoy.contract(psms).where("is_decoy = 1").count() == 3
    one = [r for r in rows(decoy.ledger(decoy.accepted(psms, 0.01))) if r["class"] == "variant"][0]
    assert (one["class_fdr"], one["all_target"], one["all_decoy"]) == (1.0, 7, 2)


def test_by_class_sink(psms, tmp_path):
    got = {r["class"]: r["rows"] for r in rows(sinks.by_class(psms, str(tmp_path / "out")))}
    assert got == {"canonical": 6, "noncanonical": 5, "variant": 1}


def test_bad_options_raise(spark, tmp_path, psms):
    with pytest.raises(ValueError, match="columns"):
        decoy.check_options(0.01, "psm", ["a"], ["b"], "score", None)
    for alpha, unit, score, q in ((0, "psm", "s", None), (0.1, "protein", "s", None), (0.1, "psm", None, None), (0.1, "psm", "s", "q")):
        with pytest.raises(ValueError):
            decoy.check_options(alpha, unit, [], [], score, q)


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_equals_sequential(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.choice([None, *map(float, range(12))]), rng.random() < 0.3) for i in range(300)]
    got = {r["i"]: r["q"] for r in rows(decoy.q_sweep(spark.createDataFrame(data, "i long, s double, d boolean"), "s", "d", "i"))}
    best = sorted((x for x in data if x[1] is not None), key=lambda x: -x[1])
    t = n = 0
    rates = []
    for _, _, d in best:
        t, n = t + (not d), n + d
        rates.append(n / max(t, 1))
    low, want = 1.0, {}
    for (i, *_), r in zip(reversed(best), reversed(rates), strict=True):
        low = want[i] = min(low, r)
    assert got == {i: want.get(i) for i, *_ in data}


def test_line_fit_and_constancy(spark):
    fit = rows(decoy.line_fit(spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (2.0, 5.0)], "x double, y double"), "x", "y"))[0]
    assert (round(fit["slope"], 9), round(fit["intercept"], 9), round(fit["se_at_one"], 9)) == (2, 1, 0)
    fold = lambda v: rows(decoy.constancy(spark.createDataFrame([(float(x),) for x in v], "v double"), "v"))[0]["fold"]
    assert fold([1, 2, 4]) == 4 and fold([1, 1.01, 0.99]) < C.CONSTANCY_FOLD and fold([1, math.nan]) == math.inf and fold([math.nan, 1]) == math.inf
    assert decoy.verdict(2, 9, 9, 0, 1) == "inconclusive" and decoy.verdict(5, 2, 1, 0.01, 0.02) == "deceptive"


CLAIM = dict.fromkeys(C.CLAIM_COLUMNS, "not reported") | {"_source": "x", "citation_doi_pmid": "10.1/x", "peptide_sequence": "ABCDEFGHI", "extraction_confidence": "high", "source_provenance": "primary", "meets_consensus_bar_as_reported": "yes"}
STRONG = CLAIM | {"hla_allele": "HLA-A*02:01", "evidence_types": "riboseq;immunopeptidomics_ms", "reported_fdr": "0.001", "psm_qvalue": "0.0004", "accepted_decoys_in_class": "4", "n_unique_peptides": "3", "ligand_len": "9", "source_pep_len": "11", "periodicity_pct": "82", "tumor_specificity_modality": "normal-ligandome-broad", "tumor_specificity_scope": "per-claim-reported", "tumor_specificity_result": "absent-from-normal", "validation_level": "T-cell-validated"}


def scored(spark, *claims):
    return ladder.scored(spark.createDataFrame([Row(**c) for c in claims], ", ".join(f"{c} string" for c in CLAIM)))


def test_positive_controls_by_every_route(spark):
    by_protein = STRONG | {"evidence_types": "immunopeptidomics_ms", "periodicity_pct": "not reported"}
    for r in scored(spark, STRONG, by_protein).collect():
        assert all(r[d].adjudicable and r[d].outcome == "supports" for d in C.DIMENSIONS)


def test_unassayed_is_never_a_failure(spark):
    for r in scored(spark, CLAIM, CLAIM | {"validation_level": "MS-presented"}, CLAIM | {"evidence_types": None, "validation_level": None}).collect():
        assert r.human_tcell_assay.outcome == "not-adjudicable" and not r.human_tcell_assay.asserted
    assert scored(spark, CLAIM | {"validation_level": "in-vivo"}).first().human_tcell_assay.outcome == "not-adjudicable"


def test_ladder_is_monotone(spark):
    gates.monotone_ladder(ladder.ladder(scored(spark, STRONG, CLAIM, STRONG | {"hla_allele": "NA"})))


def test_num_and_tokens(spark):
    texts = ["5", " 5 % ", "0.01%", "5d", "1_000", "na", None, "1e-3", "abc", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(K.num(F.col("t"))).collect()]
    assert got == [5.0, 5.0, 0.01, None, None, None, None, 0.001, None, None]
    cell = spark.createDataFrame([("M(Oxidation)PSPIDHPR; short, ABCDEFGH",)], "c string").select(K.peptides(F.col("c"))).first()[0]
    assert cell == ["MPSPIDHPR", "ABCDEFGH"]


def test_symbols(spark):
    t = spark.createDataFrame([("RPS3AP12",), ("ENSG1",), ("1P1",), (None,), ("XP",)], "s string")
    assert [r[0] for r in t.select(K.pseudogene_parent(F.col("s"))).collect()] == ["RPS3A", None, None, None, None]
    g = spark.createDataFrame([("MAGEA4",), ("MAGEA4-AS1",), ("TPTE",), ("TP53",), (None,)], "g string")
    assert [r[0] for r in g.select(K.is_control(F.col("g"))).collect()] == [True, False, True, False, False]
    pairs = [("RPS3", "RPS3"), ("RPS3", "RPS3A"), ("RP1", "RP2"), ("KRT18", "KRT8"), ("ABC1", "ABCX"), ("ABCX", "ABCY"), ("RPL1", "RPL12"), ("RPL", "RPL"), ("AB", "AB1"), ("", "X1"), ("XYZ", "XYZ7P2")]

    def same(a, b):
        root = os.path.commonprefix([a, b])
        return a == b or (len(root) >= 3 and (a[len(root):].isdigit() or b[len(root):].isdigit()))

    p = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in p.select(K.drift_equal(F.col("a"), F.col("b"))).collect()] == [same(a, b) for a, b in pairs]
    plain = spark.createDataFrame([("M(Oxidation)PSPIDHPR; ABCDEFGH, short",)], "c string").select(K.peptides(F.col("c"), annotated=False)).first()[0]
    assert plain == ["ABCDEFGH"]


def test_intervals(spark):
    t = spark.createDataFrame([(0.05, 0.5), (0.05, 0.2), (0.05, 0.05)], "q double, f double").select(K.class_fdr_bounds(F.col("q"), F.col("f")).alias("b"))
    assert [(round(r.b.low, 9), round(r.b.high, 9)) for r in t.collect()] == [(0, 0.1), (0, 0.25), (0, 1)]
    u = spark.createDataFrame([(14364357, 2907391, 10409261)], "u long, h long, n_canon long")
    r = sequence.union_interval(u, [7501870]).first()
    assert r.headroom == 7501870 and round(100 * r.ceiling, 2) == 47.60 and round(r.high, 12) == round(r.ceiling, 12)


def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    refs = ["".join(rng.choice("AB") for _ in range(rng.choice([5, 700, 1300]))) for _ in range(12)] + ["", "A"]
    qs = ["".join(rng.choice("AB") for _ in range(k)) for k in range(3, 14) for _ in range(20)]
    q, r = spark.createDataFrame([(x,) for x in qs], "seq string"), spark.createDataFrame([*enumerate(refs), (99, None)], "id long, text string")
    want = {x for x in qs if any(x in t for t in refs)}
    assert {x.seq for x in sequence.contained(q, r).collect()} == want
    pairs = {(x, i) for x in qs for i, t in enumerate(refs) if x in t}
    assert {(x.seq, x.id) for x in sequence.matches(q, r, ["id"]).collect()} == pairs
    assert {(x.seq, x.id) for x in sequence.seed_matches(q, r, ["id"], 3).collect()} == pairs


def test_ranks(spark):
    t = spark.createDataFrame([(3.0, 1), (1.0, 2), (1.0, 3)], "v double, w int")
    assert sorted(r["rank"] for r in rows(stats.midranks(t, "v"))) == [1.5, 1.5, 3.0]
    assert stats.quantile_edges(spark.createDataFrame([(float(i),) for i in range(10)], "v double"), "v", 5) == [2.0, 4.0, 6.0, 8.0]
    assert round(stats.spearman(t, "v", "w").first().rho, 9) == round(-0.8660254037844387, 9)


def test_lcg_jumps(spark):
    x, seq = 42, []
    for _ in range(500):
        x = (x * resample.LCG_MULTIPLIER + resample.LCG_INCREMENT) % 2**64
        seq.append((x >> 33) % 17)
    assert resample.lcg_draws(42, 0, 500, 17).tolist() == seq
    assert resample.lcg_draws(42, 123, 77, 17).tolist() == seq[123:200]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6), (7, None)], "a long, b long")
    assert {r.node: r.component for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
    assert graph.connected_components(e.limit(0)).count() == 0


def test_first_and_last(spark):
    t = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), ("", 4)], "k string, i long")
    assert sorted(r.i for r in ladder.first_by_key(t, "k", "i", F.col("k") == "").collect()) == [1, 3, 4]
    base, over = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int"), spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "k string, v int, o int")
    assert {r.k: r.v for r in registry.last_wins(base, over, "k", "v", "o").collect()} == {"a": 2, "b": 0}


def test_gates(spark):
    t = spark.createDataFrame([(1, 2)], "k long, v long")
    with pytest.raises(gates.GateError):
        gates.not_empty(t.limit(0), "x")
    with pytest.raises(gates.GateError):
        gates.same(t, t.withColumn("v", F.lit(3).cast("long")), "k", "v")
    with pytest.raises(gates.GateError):
        gates.same_unit("peptide", "kmer9")
    with pytest.raises(gates.GateError):
        gates.no_retired_columns(t.withColumnRenamed("v", "min_peptide_len"))
    gates.partition(t, [F.col("k") == 1, F.col("k") == 2], "x")


def test_readers(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">sp|P1|AAA_HUMAN x OX=9606 GN=GENEA\nMKLV\nAAA\n>sp|P2|BBB_MOUSE OX=10090\nMMM\n")
    f = {r.acc: (r.entry, r.gene, r.seq) for r in readers.fasta(spark, str(tmp_path / "p.fasta")).collect()}
    assert f == {"P1": ("AAA_HUMAN", "GENEA", "MKLVAAA"), "P2": ("BBB_MOUSE", None, "MMM")}
    assert readers.fasta(spark, str(tmp_path / "p.fasta"), species="9606").count() == 1
    (tmp_path / "a.tsv").write_text("head\nabcd\tx\tG_9aa\tliver\nab1\t3\tG\tl\nshort\t1\nEFG\t3.0\tH\tlung\n")
    assert {(r.seq, r.length) for r in readers.atlas_sequences(spark, str(tmp_path / "a.tsv")).collect()} == {("ABCD", 4), ("EFG", 3)}
    (tmp_path / "x.pepXML").write_text('<a><search_hit hit_rank="1" peptide="AAK" protein="rev_sp|1"><search_score name="hyperscore" value="9.5"/></search_hit><search_hit hit_rank="2" peptide="B" protein="p"><search_score name="hyperscore" value="1"/></search_hit></a>')
    assert [(r.peptide, r.score, r.is_decoy, r.accession) for r in readers.pepxml(spark, str(tmp_path / "x.pepXML")).collect()] == [("AAK", 9.5, True, "sp|1")]
    (tmp_path / "g.gct").write_text("#1.2\n2\t2\nName\tDescription\tA\tB\nENSG1.4\tG\t1\t5\nENSG2.1\tG\t3\t2\n")
    assert readers.expression_gct(spark, str(tmp_path / "g.gct")).first().vector == [3.0, 5.0]
    assert {r.gene for r in readers.expression_gct(spark, str(tmp_path / "g.gct"), True).collect()} == {"ENSG1", "ENSG2"}
    (tmp_path / "g.gtf").write_text('#c\n1\tx\ttranscript\t1\t2\t.\t+\t.\tgene_id "ENSG1.2"; transcript_id "ENST1.3"; gene_name "N.1";\n')
    assert [(r.gene_id, r.transcript_id, r.gene_name) for r in readers.gtf(spark, str(tmp_path / "g.gtf"), "transcript").collect()] == [("ENSG1", "ENST1", "N.1")]
    assert readers.gtf(spark, str(tmp_path / "none.gtf"), "gene").count() == 0
    (tmp_path / "e.tsv").write_text("#x\n9606.ENSP1\tx\t0\n")
    with pytest.raises(ValueError):
        readers.abundance(spark, str(tmp_path / "e.tsv"))
    sheet = spark.createDataFrame([(0, ["title"]), (1, ["Gene Symbol", "Peptide"]), (2, ["A", "B"])], "_row_idx long, cells array<string>")
    assert [(r.cells, r.header) for r in readers.sheet(sheet, ["gene", "peptide"]).collect()] == [(["A", "B"], ["Gene Symbol", "Peptide"])]
    assert readers.digests(spark, str(tmp_path / "g.gct")).first().length > 0


def test_stream(spark, tmp_path):
    from veristrata.streaming.ledger import ledger_to_table, windowed_ledger

    t = spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 'c' AS class, false AS is_decoy UNION ALL SELECT timestamp'2024-01-09 01:00:00', 'c', true")
    t.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    ledger_to_table(windowed_ledger(s), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r["class"], r.n_target) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("c", 1)]
