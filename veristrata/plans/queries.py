"""Queries of the audit on the generated tables, each composed of operators, with the same as SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata import config as C
from veristrata.functions import columns as K
from veristrata.functions import evidence as E
from veristrata.operators import decoy, gates, graph, kmers, ladder, registry, resample, sequence, stats
from veristrata.plans import base as B
from veristrata.plans.checkpoint import store

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- claims -----------------------------------------------------------------------------------------------------

_T = "lower(trim(coalesce({0}, '')))"
_NR = "('', 'not reported', 'not stated', 'na', 'n/a', 'nr', 'none', 'insufficient-info')"
_AB = "('not reported', 'not stated', '', 'insufficient-info')"
_NUM = "CASE WHEN " + _T + " NOT IN " + _NR + " THEN TRY_CAST(trim(rtrim(" + _T + ", '%')) AS DOUBLE) END"
_t, _n = _T.format, _NUM.format
_EV = "(" + _t("evidence_types") + ")"
_MS = f"({_EV} LIKE '%immunopeptidom%' OR {_EV} LIKE '%proteomic%' OR {_EV} LIKE '%ms%')"
_EL = f"({_EV} LIKE '%immunopeptidom%' OR {_EV} LIKE '%eluted%' OR {_EV} LIKE '%hla-ms%')"
_MO, _SC, _RE, _VL = (_t(c) for c in ("tumor_specificity_modality", "tumor_specificity_scope", "tumor_specificity_result", "validation_level"))
_LIG = "('normal-ligandome-broad', 'normal-ligandome-matched')"
_ALL = "('normal-ligandome-broad', 'normal-ligandome-matched', 'normal-rna-broad', 'normal-rna-matched')"
_PER, _FDR, _NP, _SL, _LL = (_n(c) for c in ("periodicity_pct", "reported_fdr", "n_unique_peptides", "source_pep_len", "ligand_len"))
_RIBO = f"{_EV} LIKE '%ribo%'"
_LINK = f"({_SC} = 'per-claim-reported' AND {_RE} IN ('absent-from-normal', 'detected-in-normal'))"
_KNOWN = f"{_VL} IN ('t-cell-validated', 'validated_negative', 'in-vivo')"
#: asserted, claim_linked, quantitative, modality, outcome of each dimension, as SQL.
_DIMS = {
    "source_translation": (f"({_RIBO} OR {_MS})", f"({_RIBO} OR {_MS})", f"(({_RIBO} AND {_PER} IS NOT NULL) OR ({_FDR} IS NOT NULL AND {_NP} IS NOT NULL AND {_SL} IS NOT NULL))", f"({_RIBO} OR {_MS})",
        f"CASE WHEN CASE WHEN {_RIBO} AND {_PER} IS NOT NULL THEN {_PER} >= 70 ELSE {_FDR} <= 0.001 AND {_NP} >= 2 AND {_SL} >= 9 END THEN 'supports' ELSE 'contradicts' END"),
    "hla_elution": (f"({_EL} OR {_EV} LIKE '%predict%')", f"({_EL} AND {_t('peptide_sequence')} NOT IN {_NR})", f"({_LL} IS NOT NULL)", _EL, f"CASE WHEN {_LL} BETWEEN 8 AND 12 THEN 'supports' ELSE 'indirect' END"),
    "allele_restriction": (_EL, f"({_t('hla_allele')} NOT IN {_NR})", f"({_t('hla_allele')} NOT IN {_NR})", _EL, "'supports'"),
    "normal_presentation": (f"({_MO} IN {_ALL})", _LINK, _LINK, f"({_MO} IN {_LIG})", f"CASE WHEN {_RE} = 'detected-in-normal' THEN 'contradicts' ELSE 'supports' END"),
    "human_tcell_assay": (f"({_KNOWN} OR {_EV} LIKE '%t-cell%')", f"({_KNOWN})", f"({_KNOWN})", f"({_VL} <> 'in-vivo')", f"CASE WHEN {_VL} = 't-cell-validated' THEN 'supports' ELSE 'contradicts' END"),
    "class_fdr_reconstructible": (_MS, f"({_n('psm_qvalue')} IS NOT NULL)", f"({_n('psm_qvalue')} IS NOT NULL)", f"({_t('accepted_decoys_in_class')} NOT IN {_NR})", "'supports'"),
}
_SCORED = "c AS (" + B.CLAIMS_SQL + "), s AS (SELECT *, " + ", ".join(f"{a} AS {d}_1, {b} AS {d}_2, {q} AS {d}_3, {m} AS {d}_4, {o} AS {d}_o" for d, (a, b, q, m, o) in _DIMS.items()) + " FROM c)"


def _adj(d: str) -> str:
    return "(" + " AND ".join(f"{d}_{i}" for i in range(1, 5)) + ")"


def _ladder_sql(by: str = "") -> str:
    rows = []
    for d in C.DIMENSIONS:
        tests = [(r, " AND ".join(f"{d}_{i}" for i in range(1, min(k, 4) + 1))) for k, r in enumerate(C.RUNGS, 1)]
        tests += [(o, f"{_adj(d)} AND {d}_o = '{o}'") for o in ("supports", "contradicts", "indirect")]
        rows += [f"SELECT {by + ', ' if by else ''}'{d}' AS dimension, '{r}' AS rung, count(*) FILTER (WHERE {t}) AS n FROM s{' GROUP BY ' + by if by else ''}" for r, t in tests]
    return f"WITH {_SCORED} " + " UNION ALL ".join(rows)


def _scored(spark, d) -> DataFrame:
    return ladder.scored(B.claims(spark, d))


@query(_ladder_sql())
def claim_ladder_pooled(spark, d):
    return ladder.ladder(_scored(spark, d))


_STRATUM = f"CASE WHEN {_KNOWN} OR {_EV} LIKE '%t-cell%' THEN '3. T-cell-tested' WHEN _source LIKE 'cohort:%' THEN '2. end-to-end cohort' ELSE '1. atlas ligand record' END"


@query(_ladder_sql("stratum").replace("SELECT *, ", f"SELECT *, {_STRATUM} AS stratum, ", 1))
def claim_ladder_by_stratum(spark, d):
    return ladder.ladder(_scored(spark, d).withColumn("stratum", E.stratum()), ["stratum"])


_TSTATE = f"CASE WHEN {_VL} = 't-cell-validated' THEN 'human-assay-positive' WHEN {_VL} = 'validated_negative' THEN 'human-assay-negative' WHEN {_VL} = 'in-vivo' THEN 'nonhuman-assay-indirect' WHEN {_EV} LIKE '%t-cell%' THEN 'assayed-result-not-claim-linked' ELSE 'not-assayed' END"


@query(f"WITH c AS ({B.CLAIMS_SQL}) SELECT orf_class, {_TSTATE} AS state, count(*) AS n FROM c GROUP BY 1, 2")
def tcell_state_counts(spark, d):
    return ladder.counts(B.claims(spark, d).withColumn("state", E.human_tcell_state()), ["orf_class", "state"])


@query(f"WITH c AS ({B.CLAIMS_SQL}) SELECT orf_class, CASE WHEN {_RE} = 'detected-in-normal' THEN 'explicit-normal-detection' WHEN {_MO} NOT IN {_ALL} THEN 'not-reported' WHEN {_MO} IN {_LIG} AND {_SC} = 'per-claim-reported' THEN 'modality-appropriate-claim-linked' ELSE 'indirect' END AS state, count(*) AS n FROM c GROUP BY 1, 2")
def normal_state_counts(spark, d):
    return ladder.counts(B.claims(spark, d).withColumn("state", E.normal_presentation_state()), ["orf_class", "state"])


def _problems_sql() -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    rows = [f"SELECT '{c} not in vocabulary' AS problem FROM c WHERE trim(coalesce({c}, '')) <> '' AND trim({c}) NOT IN ({', '.join(map(quote, v))})" for c, v in C.VOCABULARY.items()]
    rows.append("SELECT 'citation_doi_pmid is required' FROM c WHERE trim(coalesce(citation_doi_pmid, '')) = ''")
    return f"WITH c AS ({B.CLAIMS_SQL}) SELECT problem, count(*) AS n FROM ({' UNION ALL '.join(rows)}) GROUP BY problem"


@query(_problems_sql())
def validate_problems(spark, d):
    return ladder.counts(B.claims(spark, d).select(F.explode(E.problems()).alias("problem")), ["problem"])


_F = "CAST(count(*) FILTER (WHERE {0}) AS BIGINT) AS {1}".format


@query(
    f"WITH {_SCORED} SELECT count(*) AS claims, "
    + ", ".join([_F(_adj("source_translation"), "translation_strict"), _F(f"{_FDR} IS NOT NULL", "any_fdr"), _F(f"{_PER} IS NOT NULL", "any_periodicity"), _F(f"{_n('psm_qvalue')} IS NOT NULL", "any_qvalue"), _F(_RIBO, "binary_ribo"), _F("allele_restriction_1 AND allele_restriction_2 OR allele_restriction_2", "allele"), _F(_adj("normal_presentation"), "ligandome_claim"), _F(f"{_MO} IN {_LIG}", "any_ligandome"), _F(f"{_MO} IN {_ALL}", "any_modality"), _F(_adj("human_tcell_assay"), "tcell_strict"), _F(f"({_TSTATE}) = 'human-assay-positive'", "tcell_positive"), _F(f"({_TSTATE}) = 'nonhuman-assay-indirect'", "tcell_nonhuman"), _F(f"({_TSTATE}) = 'assayed-result-not-claim-linked'", "tcell_not_linked")])
    + " FROM s"
)
def leniency_counts(spark, d):
    return ladder.leniency(_scored(spark, d))


_PRES = lambda c: f"({_t(c)} NOT IN {_AB})"
_REUSE = " + ".join(f"CAST({_PRES(c)} AS INT)" for c in C.REUSE_FIELDS)
_FLAGS_SQL = f"""WITH {_SCORED}, f AS (SELECT peptide_sequence AS seq, false AS is_control, bool_or({_PRES('hla_allele')}) AS allele, bool_or({_PRES('periodicity_pct')} OR {_PRES('reported_fdr')}) AS source_rigor_reported,
  bool_or({_PRES('tumor_specificity_modality')}) AS specificity_reported, bool_or({_PRES('validation_level')}) AS immuno_reported, bool_or({_adj('source_translation')} AND source_translation_o = 'supports') AS source_strict,
  bool_or({_adj('hla_elution')} AND hla_elution_o = 'supports') AS hla_strict, bool_or({_adj('normal_presentation')}) AS specificity_strict, bool_or({_adj('human_tcell_assay')} AND human_tcell_assay_o = 'supports') AS immuno_strict,
  bool_or({_adj('source_translation')}) AS source_decidable, bool_or({_adj('normal_presentation')}) AS specificity_decidable, CAST(max({_REUSE}) AS BIGINT) AS reuse
  FROM s WHERE peptide_sequence <> '' GROUP BY peptide_sequence)"""


@query(_FLAGS_SQL + " SELECT * FROM f")
def peptide_any_flags(spark, d):
    return ladder.peptide_flags(_scored(spark, d))


@query(_FLAGS_SQL + " SELECT reuse, count(*) AS n FROM f GROUP BY reuse")
def reuse_histogram(spark, d):
    return ladder.counts(ladder.peptide_flags(_scored(spark, d)), ["reuse"])


def _flagged(spark, d) -> DataFrame:
    flags = ladder.peptide_flags(_scored(spark, d))
    canon = sequence.seed_matches(flags, B.references(spark, d), ["item_id"], 7)
    return sequence.flagged(sequence.flagged(flags, canon, "seq", "canonical"), B.normal(spark, d), "seq", "in_normal")


_CANON = f", r AS ({B.REFERENCES_SQL}), nn AS ({B.NORMAL_SQL}), g AS (SELECT f.*, EXISTS (SELECT 1 FROM r WHERE contains(r.text, f.seq)) AS canonical, seq IN (SELECT seq FROM nn) AS in_normal FROM f)"
_STAGES = [("all", "true"), ("not canonical", "NOT canonical"), ("not in normal", "NOT in_normal"), ("elution supports", "hla_strict"), ("translation supports", "source_strict"), ("assay positive", "immuno_strict")]


@query(_FLAGS_SQL + _CANON + " " + " UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) FILTER (WHERE {' AND '.join(t for _, t in _STAGES[: i + 1])}) AS n FROM g" for i, (s, _) in enumerate(_STAGES)))
def evidence_cascade(spark, d):
    c = F.col
    return ladder.cascade(_flagged(spark, d), [("all", F.lit(True)), ("not canonical", ~c("canonical")), ("not in normal", ~c("in_normal")), ("elution supports", c("hla_strict")), ("translation supports", c("source_strict")), ("assay positive", c("immuno_strict"))])


@query(_FLAGS_SQL + _CANON + " SELECT CASE WHEN canonical THEN '0_canonical-self' WHEN in_normal THEN '1_normal-present' WHEN NOT allele THEN '2_provenance-clean' WHEN NOT source_rigor_reported THEN '3_actionable-presentation' WHEN NOT immuno_reported THEN '4_translation-stat-reported' ELSE '5_immunogenicity-reported' END AS tier, count(*) AS n FROM g GROUP BY 1")
def peptide_tiers(spark, d):
    return ladder.counts(_flagged(spark, d).withColumn("tier", E.peptide_tier(F.col("canonical"), F.col("in_normal"))), ["tier"])


@query(f"WITH c AS ({B.CLAIMS_SQL}) SELECT peptide_sequence, min(claim_id) AS claim_id FROM c WHERE peptide_sequence <> '' GROUP BY 1 UNION ALL SELECT peptide_sequence, claim_id FROM c WHERE peptide_sequence = ''")
def first_claims(spark, d):
    return ladder.first_by_key(B.claims(spark, d), "peptide_sequence", "claim_id", F.col("peptide_sequence") == "").select("peptide_sequence", "claim_id")


@query("SELECT source, CASE WHEN bool_or(lang = 'en') AND bool_or(lang <> 'en') THEN 'mixed' WHEN bool_or(lang = 'en') THEN 'only-a' ELSE 'only-b' END AS stratum, count(*) AS n FROM documents GROUP BY source")
def label_strata_partition(spark, d):
    t = B.table(spark, d, "documents").groupBy("source").agg(F.bool_or(F.col("lang") == "en").alias("a"), F.bool_or(F.col("lang") != "en").alias("b"), F.count("*").alias("n"))
    return t.select("source", K.label_stratum(F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))).alias("stratum"), "n")


# ---- containment ------------------------------------------------------------------------------------------------

_OR = f"o AS ({B.OCCURRENCES_SQL}), r AS ({B.REFERENCES_SQL}), q AS (SELECT DISTINCT seq FROM o), h AS (SELECT q.seq, EXISTS (SELECT 1 FROM r WHERE contains(r.text, q.seq)) AS hit FROM q)"


def _hits(spark, d) -> DataFrame:
    q = B.occurrences(spark, d).select("seq").distinct()
    return sequence.flagged(q, sequence.contained(q, B.references(spark, d), lengths=B.LENGTHS), "seq", "hit")


@query(f"WITH {_OR} SELECT seq FROM h WHERE hit")
def overlap_exact(spark, d):
    return sequence.contained(B.occurrences(spark, d).select("seq").distinct(), B.references(spark, d), lengths=B.LENGTHS)


@query(f"WITH {_OR} SELECT DISTINCT translate(q.seq, 'I', 'L') AS seq FROM q WHERE EXISTS (SELECT 1 FROM r WHERE contains(translate(r.text, 'I', 'L'), translate(q.seq, 'I', 'L')))")
def overlap_collapsed(spark, d):
    q = B.occurrences(spark, d).select(sequence.collapse_il(F.col("seq")).alias("seq")).distinct()
    return sequence.contained(q, B.references(spark, d).select(sequence.collapse_il(F.col("text")).alias("text")), lengths=B.LENGTHS)


@query(f"WITH {_OR} SELECT CAST(length(seq) AS INT) AS length, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM h GROUP BY 1")
def overlap_by_length(spark, d):
    return _hits(spark, d).groupBy(F.length("seq").alias("length")).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))


@query(f"WITH {_OR}, a AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS k FROM h), b AS (SELECT *, k / n AS p, 1 + 3.8416 / n AS dd FROM a) SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(p, 9) AS p, round((p + 1.9208 / n) / dd - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n)) / dd, 9) AS low, round((p + 1.9208 / n) / dd + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n)) / dd, 9) AS high FROM b")
def overlap_wilson(spark, d):
    a = _hits(spark, d).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("k"))
    w = a.select("n", "k", K.wilson(F.col("k"), F.col("n")).alias("w"))
    return w.select("n", "k", *[F.round(f"w.{c}", 9).alias(c) for c in ("p", "low", "high")])


@query(f"WITH {_OR} SELECT tissue, gene, count(DISTINCT o.seq) AS n, count(DISTINCT CASE WHEN hit THEN o.seq END) AS hits FROM o JOIN h ON o.seq = h.seq GROUP BY 1, 2")
def overlap_by_class(spark, d):
    o = B.occurrences(spark, d).distinct().join(_hits(spark, d), "seq")
    return o.groupBy("tissue", "gene").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))


@query(f"WITH {_OR}, m AS (SELECT q.seq, count(*) AS k FROM q JOIN r ON contains(r.text, q.seq) GROUP BY q.seq) SELECT count(*) AS n, median(k) AS median, max(k) AS most, count(*) FILTER (WHERE k = 1) AS one, count(*) FILTER (WHERE k <= 2) AS upto_two FROM m")
def compatible_sources(spark, d):
    m = sequence.matches(B.occurrences(spark, d), B.references(spark, d), ["item_id"], lengths=B.LENGTHS).groupBy("seq").agg(F.count_distinct("item_id").alias("k"))
    m = store(m, "sources")
    return m.agg(F.count("*").alias("n"), F.lit(stats.exact_percentile(m, "k", 0.5)).cast("double").alias("median"), F.max("k").alias("most"), F.sum((F.col("k") == 1).cast("long")).alias("one"), F.sum((F.col("k") <= 2).cast("long")).alias("upto_two"))


@query(f"WITH {_OR}, c AS (SELECT upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS text FROM conversations), x AS (SELECT seq FROM h WHERE hit), y AS (SELECT seq FROM q WHERE EXISTS (SELECT 1 FROM c WHERE contains(c.text, q.seq))) SELECT (SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS both, (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)) AS only_a, (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) AS only_b")
def era_reference_diff(spark, d):
    q = B.occurrences(spark, d).select("seq").distinct()
    later = B.table(spark, d, "conversations").select(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("text"))
    return sequence.reference_difference(sequence.contained(q, B.references(spark, d), lengths=B.LENGTHS), sequence.contained(q, later, lengths=B.LENGTHS), "seq")


def _library(spark, d) -> DataFrame:
    t = B.table(spark, d, "conversations").select("role", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("text"))
    return kmers.library_union(t.where("role = 'user'"), t.where("role <> 'user'"), B.references(spark, d), C.KMER)


_KM = "SELECT DISTINCT substring(text, CAST(i AS INT), 9) AS kmer FROM (SELECT text, unnest(range(1, length(text) - 7)) AS i FROM ({0}) WHERE length(text) >= 9)".format
_CV = "SELECT upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS text FROM conversations WHERE role {0} 'user'".format
_LIB = f"WITH a AS ({_KM(_CV('='))}), b AS ({_KM(_CV('<>'))}), c AS ({_KM(B.REFERENCES_SQL)}), l AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (kmer)) AS n_both, (SELECT count(*) FROM c) AS n_canon, (SELECT count(*) FROM a JOIN c USING (kmer)) AS hit_a, (SELECT count(*) FROM b JOIN c USING (kmer)) AS hit_b, (SELECT count(*) FROM a JOIN b USING (kmer) JOIN c USING (kmer)) AS hit_both), k AS (SELECT *, n_a + n_b - n_both AS u, hit_a + hit_b - hit_both AS h FROM l)"


@query(_LIB + " SELECT * FROM k")
def library_kmer_rates(spark, d):
    return _library(spark, d)


_GRID = [0, 100, 10_000, 1_000_000]


@query(_LIB + f" SELECT m, round(h / (u + m), 12) AS low, round((h + least(m, n_canon - h)) / (u + m), 12) AS high, round(n_canon / (u + n_canon - h), 12) AS ceiling, n_canon - h AS headroom FROM k, (SELECT CAST(unnest({_GRID}) AS BIGINT) AS m)")
def library_union_interval(spark, d):
    return sequence.union_interval(_library(spark, d), _GRID).select("m", F.round("low", 12).alias("low"), F.round("high", 12).alias("high"), F.round("ceiling", 12).alias("ceiling"), "headroom")


@query(f"WITH r AS ({B.REFERENCES_SQL}), t AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS text FROM documents) SELECT item_id, count(*) AS n FROM r JOIN t ON contains(t.text, r.text) WHERE length(r.text) >= 9 GROUP BY item_id")
def whole_orf_containment(spark, d):
    refs = B.table(spark, d, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("text"))
    q = B.references(spark, d).select("item_id", F.col("text").alias("seq"))
    return sequence.seed_matches(q, refs, ["doc_id"], 9).join(q, "seq").groupBy("item_id").agg(F.count("*").alias("n"))


@query(f"WITH o AS ({B.OCCURRENCES_SQL}), b AS (SELECT seq, count(DISTINCT tissue) AS breadth FROM o GROUP BY seq) SELECT breadth, count(*) AS n FROM b GROUP BY breadth")
def detection_breadth(spark, d):
    return ladder.counts(sequence.breadth(B.occurrences(spark, d)), ["breadth"])


@query(f"WITH {_OR}, b AS (SELECT seq, count(DISTINCT tissue) AS breadth FROM o GROUP BY seq) SELECT CAST(length(seq) AS INT) AS length, hit, count(*) AS n, CAST(sum(breadth) AS BIGINT) AS total, count(*) FILTER (WHERE breadth >= 2) AS two FROM b JOIN h USING (seq) GROUP BY 1, 2 HAVING count(*) >= 30")
def breadth_by_length(spark, d):
    t = sequence.breadth(B.occurrences(spark, d)).join(_hits(spark, d), "seq")
    return t.groupBy(F.length("seq").alias("length"), "hit").agg(F.count("*").alias("n"), F.sum("breadth").alias("total"), F.sum((F.col("breadth") >= 2).cast("long")).alias("two")).where("n >= 30")


@query(f"WITH {_OR}, n AS ({B.NORMAL_SQL}), a AS (SELECT CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS p FROM h), b AS (SELECT CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r WHERE contains(r.text, n.seq))) AS DOUBLE) / count(*) AS p FROM n) SELECT round(a.p, 12) AS catalogue, round(b.p, 12) AS library, round(a.p / b.p, 12) AS ratio FROM a, b")
def ratio_of_ratios(spark, d):
    n = B.normal(spark, d)
    lib = sequence.flagged(n, sequence.contained(n, B.references(spark, d), lengths=B.LENGTHS), "seq", "hit")
    one = lambda t, c: t.agg((F.sum(F.col("hit").cast("long")) / F.count("*")).alias(c))
    both = one(_hits(spark, d), "catalogue").crossJoin(one(lib, "library"))  # one row each
    return both.select(F.round("catalogue", 12).alias("catalogue"), F.round("library", 12).alias("library"), F.round(F.col("catalogue") / F.col("library"), 12).alias("ratio"))


_EXP = f"WITH {_OR}, n AS ({B.NORMAL_SQL}), e AS (SELECT q.seq, length(q.seq) AS len, h.hit AS y, q.seq IN (SELECT seq FROM n) AS x FROM q JOIN h USING (seq))"


def _exposed(spark, d) -> DataFrame:
    return sequence.flagged(_hits(spark, d), B.normal(spark, d), "seq", "x").withColumn("len", F.length("seq"))


@query(_EXP + ", g AS (SELECT len, count(*) AS n, count(*) FILTER (WHERE x AND y) AS k1, count(*) FILTER (WHERE x) AS n1, count(*) FILTER (WHERE NOT x AND y) AS k0, count(*) FILTER (WHERE NOT x) AS n0 FROM e GROUP BY len), s AS (SELECT sum(n) AS n, sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n * k1 / n1 END) AS s1, sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n * k0 / n0 END) AS s0 FROM g) SELECT round(s1 / n, 9) AS p1, round(s0 / n, 9) AS p0, round(s1 / nullif(s0, 0), 9) AS rr FROM s")
def risk_ratio_std(spark, d):
    r = stats.standardized_risk_ratio(_exposed(spark, d), F.col("x"), F.col("hit"), "len")
    return r.select(*[F.round(c, 9).alias(c) for c in ("p1", "p0", "rr")])


@query(_EXP + ", a AS (SELECT count(*) FILTER (WHERE x AND y) AS k1, count(*) FILTER (WHERE x) AS n1, count(*) FILTER (WHERE NOT x AND y) AS k0, count(*) FILTER (WHERE NOT x) AS n0 FROM e) SELECT *, round((k1 / n1) / nullif(k0 / n0, 0), 9) AS rr FROM a")
def risk_ratio_crude(spark, d):
    return stats.risk_ratio(_exposed(spark, d), F.col("x"), F.col("hit")).withColumn("rr", F.round("rr", 9))


# ---- target and decoy -------------------------------------------------------------------------------------------

_P = f"p AS ({B.PSMS_SQL})"
_Q = f"{_P}, r AS (SELECT *, sum(CAST(is_decoy AS INT)) OVER w / greatest(sum(CAST(NOT is_decoy AS INT)) OVER w, 1) AS fdr FROM p WHERE score IS NOT NULL WINDOW w AS (ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING)), q AS (SELECT * EXCLUDE (fdr), least(1.0, min(fdr) OVER (ORDER BY score, event_id DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)"
_ALPHA = 0.35


def _swept(spark, d) -> DataFrame:
    return decoy.q_sweep(B.psms(spark, d), "score", "is_decoy", "event_id")


@query(f"WITH {_Q} SELECT event_id, round(q, 12) AS q FROM q UNION ALL SELECT event_id, NULL FROM p WHERE score IS NULL")
def decoy_qsweep(spark, d):
    return _swept(spark, d).select("event_id", F.round("q", 12).alias("q"))


def _ledger_sql(rows: str) -> str:
    return f"WITH {_Q}, u AS ({rows}), c AS (SELECT class, count(*) FILTER (WHERE NOT is_decoy) AS n_target, count(*) FILTER (WHERE is_decoy) AS n_decoy FROM u GROUP BY class) SELECT class, n_target, n_decoy, round((n_decoy + 1) / greatest(n_target, 1), 12) AS class_fdr, round(n_target / greatest(CAST(sum(n_target) OVER () AS BIGINT), 1), 12) AS share, CAST(sum(n_target) OVER () AS BIGINT) AS all_target, CAST(sum(n_decoy) OVER () AS BIGINT) AS all_decoy FROM c"


def _ledger(t: DataFrame) -> DataFrame:
    return decoy.ledger(t).withColumns({c: F.round(c, 12) for c in ("class_fdr", "share")})


@query(_ledger_sql(f"SELECT * FROM q WHERE q <= {_ALPHA}"))
def decoy_ledger_psm(spark, d):
    return _ledger(decoy.accepted(_swept(spark, d), _ALPHA))


@query(_ledger_sql(f"SELECT DISTINCT class, peptide, is_decoy FROM q WHERE q <= {_ALPHA}"))
def decoy_ledger_unique(spark, d):
    return _ledger(decoy.unit_rows(decoy.accepted(_swept(spark, d), _ALPHA), "unique-peptide"))


@query(f"WITH {_Q}, k AS (SELECT class, peptide, is_decoy, count(*) AS k FROM q WHERE q <= {_ALPHA} GROUP BY 1, 2, 3) SELECT class, CASE WHEN k = 1 THEN 'n=1' WHEN k = 2 THEN 'n=2' ELSE 'n>=3' END AS depth, count(*) FILTER (WHERE NOT is_decoy) AS n_target, count(*) FILTER (WHERE is_decoy) AS n_decoy FROM k GROUP BY 1, 2")
def decoy_multiplicity(spark, d):
    return decoy.depth_strata(decoy.accepted(_swept(spark, d), _ALPHA))


@query(f"WITH {_Q} SELECT id, peptide, score, round(q, 12) AS q, CAST(is_decoy AS INT) AS is_decoy, CASE WHEN is_decoy THEN 'rev_' ELSE '' END || accession AS accession FROM q")
def decoy_contract(spark, d):
    return decoy.contract(_swept(spark, d)).withColumn("q", F.round("q", 12))


@query(f"WITH {_P}, a AS (SELECT sample, count(*) FILTER (WHERE class = 'canonical' AND NOT is_decoy) AS ct, count(*) FILTER (WHERE class = 'canonical' AND is_decoy) AS cd, count(*) FILTER (WHERE class <> 'canonical' AND NOT is_decoy) AS nt, count(*) FILTER (WHERE class <> 'canonical' AND is_decoy) AS nd FROM p GROUP BY sample) SELECT sample, round(coalesce(nt / nullif(ct + nt, 0), 'NaN'), 12) AS f, round(coalesce((cd + nd) / nullif(ct + nt, 0), 'NaN'), 12) AS q, round(coalesce(cd / nullif(ct, 0), 'NaN'), 12) AS theta_c, round(coalesce(nd / nullif(nt, 0), 'NaN'), 12) AS theta_n FROM a")
def per_sample_rates(spark, d):
    return decoy.sample_rates(B.psms(spark, d), "sample", F.col("class") == "canonical").select("sample", *[F.round(c, 12).alias(c) for c in ("f", "q", "theta_c", "theta_n")])


@query(f"WITH {_P}, a AS (SELECT sample, count(*) FILTER (WHERE class <> 'canonical' AND NOT is_decoy) / nullif(count(*) FILTER (WHERE NOT is_decoy), 0) AS f, count(*) FILTER (WHERE is_decoy) / nullif(count(*) FILTER (WHERE NOT is_decoy), 0) AS q FROM p GROUP BY sample) SELECT count(*) AS n, round(regr_slope(q, f), 6) AS slope, round(regr_intercept(q, f), 6) AS intercept FROM a WHERE f IS NOT NULL")
def eco_fit(spark, d):
    t = decoy.line_fit(decoy.sample_rates(B.psms(spark, d), "sample", F.col("class") == "canonical"), "f", "q")
    return t.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(f"WITH {_P}, a AS (SELECT sample, count(*) FILTER (WHERE class = 'canonical' AND is_decoy) / nullif(count(*) FILTER (WHERE class = 'canonical' AND NOT is_decoy), 0) AS v FROM p GROUP BY sample) SELECT count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS n_nan, round(CASE WHEN count(*) FILTER (WHERE v IS NULL) > 0 OR min(v) <= 0 THEN 'inf' ELSE max(v) / min(v) END, 9) AS fold, round(CASE WHEN count(*) FILTER (WHERE v IS NULL) > 0 THEN 'NaN' ELSE stddev_pop(v) / nullif(avg(v), 0) END, 9) AS cv FROM a")
def rate_constancy(spark, d):
    t = decoy.constancy(decoy.sample_rates(B.psms(spark, d), "sample", F.col("class") == "canonical"), "theta_c")
    return t.withColumns({c: F.round(c, 9) for c in ("fold", "cv")})


# ---- ranks, bins, standardization -------------------------------------------------------------------------------

_SIZES = "a AS (SELECT p_partkey, p_size, p_retailprice, sum(l_quantity) AS qty FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2, 3)"


def _parts(spark, d) -> DataFrame:
    q = B.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("qty"))
    return B.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice").join(q, "p_partkey")


@query(f"WITH {_SIZES}, e AS (SELECT list_sort(list(qty)) AS v, count(*) AS n FROM a), b AS (SELECT a.*, CAST((qty >= v[1 * n // 5 + 1]) AS INT) + CAST((qty >= v[2 * n // 5 + 1]) AS INT) + CAST((qty >= v[3 * n // 5 + 1]) AS INT) + CAST((qty >= v[4 * n // 5 + 1]) AS INT) AS bin FROM a, e) SELECT bin, count(*) AS n, min(qty) AS low, max(qty) AS high FROM b GROUP BY bin")
def quantile_bins(spark, d):
    t = _parts(spark, d)
    return t.withColumn("bin", F.coalesce(stats.binned(F.col("qty"), stats.quantile_edges(t, "qty", 5)), F.lit(0))).groupBy("bin").agg(F.count("*").alias("n"), F.min("qty").alias("low"), F.max("qty").alias("high"))


@query(f"WITH {_SIZES}, w AS (SELECT p_size, count(*) AS w FROM a GROUP BY 1), c AS (SELECT p_retailprice >= 1400 AS bin, p_size, count(*) AS n, sum(qty) AS s FROM a GROUP BY 1, 2) SELECT CAST(bin AS INT) AS bin, round(sum(w * s / n) / sum(w), 6) AS mean FROM c JOIN w USING (p_size) GROUP BY bin")
def mean_breadth_std_bins(spark, d):
    t = _parts(spark, d).withColumn("bin", (F.col("p_retailprice") >= 1400).cast("int"))
    return stats.standardized_mean(t, "qty", "p_size", "bin").withColumn("mean", F.round("mean", 6))


@query(f"WITH {_SIZES}, r AS (SELECT p_size > 25 AS g, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS rk FROM a), s AS (SELECT count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n0, sum(rk) FILTER (WHERE g) AS s FROM r) SELECT n1, n0, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS auc, round((s - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 9) AS z FROM s")
def auc_shift(spark, d):
    return stats.rank_sum(_parts(spark, d), "qty", F.col("p_size") > 25).select("n1", "n0", F.round("auc", 9).alias("auc"), F.round("z", 9).alias("z"))


@query(f"WITH {_SIZES}, r AS (SELECT rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2 AS x, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS y FROM a) SELECT round(corr(x, y), 9) AS rho, count(*) AS n FROM r")
def spearman_rank(spark, d):
    return stats.spearman(_parts(spark, d), "qty", "p_size").withColumn("rho", F.round("rho", 9))


# ---- vectors, registries, graph, text ---------------------------------------------------------------------------


@query("WITH v AS (SELECT list_transform(embedding, lambda x: x * 4) AS e FROM embeddings), k AS (SELECT e, len(list_filter(e, lambda x: x >= 1)) AS n FROM v) SELECT CASE WHEN e IS NULL THEN 'unresolved' WHEN n >= 27 THEN 'broad-RISK' WHEN e[1] >= 1 AND n - 1 <= 5 THEN 'testis-restricted' WHEN list_max(e) >= 1 THEN 'other-restricted' ELSE 'normal-silent' END AS category, count(*) AS n FROM k GROUP BY 1")
def expression_taxonomy(spark, d):
    v = B.table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x * 4).alias("v"))
    return ladder.counts(v.select(K.expression_class(F.col("v"), F.get("v", F.lit(0))).alias("category")), ["category"])


@query("WITH l AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings), m AS (SELECT label, i, max(embedding[i]) AS v FROM l GROUP BY 1, 2) SELECT label, CAST(i AS INT) AS i, CAST(v AS DOUBLE) AS v FROM m")
def expression_vector_max(spark, d):
    t = B.table(spark, d, "embeddings").select("label", F.col("vec_id").alias("gene"), F.col("embedding").alias("vector"))
    m = registry.vector_max(t.select("label", "gene"), t.select("gene", "vector"), "label", "gene", "vector")
    return m.select("label", F.posexplode("vector").alias("i", "v")).select("label", (F.col("i") + 1).alias("i"), F.col("v").cast("double").alias("v"))


@query("WITH s AS (SELECT s_name AS name, CAST(s_suppkey AS STRING) AS id FROM supplier WHERE s_acctbal > 0), n AS (SELECT n_name AS name, min(CAST(s_suppkey AS STRING)) AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1), q AS (SELECT s_name AS key, s_nationkey FROM supplier UNION ALL SELECT n_name, n_nationkey FROM nation) SELECT key, coalesce(s.id, n.id) AS id, CASE WHEN s.id IS NOT NULL THEN 'symbol' WHEN n.id IS NOT NULL THEN 'synonym' END AS route FROM q LEFT JOIN s ON s.name = key LEFT JOIN n ON n.name = key")
def id_cascade(spark, d):
    s, n = B.table(spark, d, "supplier"), B.table(spark, d, "nation")
    keys = s.select(F.col("s_name").alias("key")).unionAll(n.select("n_name"))
    ident = F.col("s_suppkey").cast("string").alias("id")
    symbol = s.where("s_acctbal > 0").select(F.col("s_name").alias("name"), ident)
    synonym = registry.unique_only(s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("name"), ident), "name", "id")
    return registry.cascade_lookup(keys, "key", [("symbol", symbol), ("synonym", synonym)])


@query(f"WITH RECURSIVE r AS ({B.REFERENCES_SQL}), w AS (SELECT DISTINCT item_id, substring(text, CAST(i AS INT), 10) AS k FROM (SELECT item_id, text, unnest(range(1, length(text) - 8)) AS i FROM r WHERE length(text) >= 10)), e AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM w a JOIN w b ON a.k = b.k AND a.item_id <> b.item_id), l AS (SELECT a AS node, a AS low FROM e UNION SELECT e.b, l.low FROM l JOIN e ON l.node = e.a WHERE l.low < e.b) SELECT node, min(low) AS component FROM l GROUP BY node")
def connected_components(spark, d):
    return graph.connected_components(kmers.star_edges(B.references(spark, d), "item_id", "text", 10))


_FAMILY = f"WITH r AS ({B.REFERENCES_SQL}), p AS (SELECT DISTINCT item_id, substring(text, CAST(i AS INT), 12) AS k FROM (SELECT item_id, text, unnest(range(1, length(text) - 10)) AS i FROM r WHERE length(text) >= 12)), t AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM r)), w AS (SELECT doc_id, substring(text, CAST(i AS INT), 12) AS k FROM (SELECT doc_id, text, unnest(range(1, length(text) - 10)) AS i FROM t WHERE length(text) >= 12)), f AS (SELECT item_id, doc_id, count(*) AS places FROM w JOIN p USING (k) GROUP BY ALL)"


@query(_FAMILY + " SELECT item_id, count(*) AS relatives, count(*) FILTER (WHERE places >= 10) AS strong, CAST(sum(places) AS BIGINT) AS places, max(places) AS most FROM f GROUP BY item_id")
def family_places(spark, d):
    """Texts that share 12-mers with a reference, by the places that do; texts whose id is a reference's are left out."""
    refs = B.references(spark, d).withColumnRenamed("item_id", "member")
    pool = B.table(spark, d, "documents").select(F.col("doc_id").alias("gene"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("text"))
    f = kmers.family_counts(refs, pool, 12).groupBy(F.col("member").alias("item_id"))
    return f.agg(F.count("*").alias("relatives"), F.sum((F.col("places") >= 10).cast("long")).alias("strong"), F.sum("places").alias("places"), F.max("places").alias("most"))


@query("SELECT 'the' AS quote, count(*) FILTER (WHERE contains(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'the')) AS n FROM pages UNION ALL SELECT 'no such quote', count(*) FILTER (WHERE contains(html, 'no such quote')) FROM pages")
def html_quote_check(spark, d):
    return gates.quotes_present(B.table(spark, d, "pages"), "html", ["the", "no such quote"])


@query("SELECT event_type AS class, date_trunc('day', ts) AS start, count(*) FILTER (WHERE value < 50) AS n_decoy, count(*) FILTER (WHERE value >= 50) AS n_target FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def daily_ledger(spark, d):
    t = B.table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("class"), "ts", (F.col("value") < 50).cast("long").alias("x"))
    return t.groupBy("class", F.date_trunc("day", "ts").alias("start")).agg(F.sum("x").alias("n_decoy"), F.sum(1 - F.col("x")).alias("n_target"))


@query()
def bootstrap_ci(spark, d):
    t = sequence.flagged(B.occurrences(spark, d).groupBy("seq").agg(F.min("gene").alias("gene")).join(_hits(spark, d), "seq"), B.normal(spark, d), "seq", "x").withColumn("len", F.length("seq"))
    cells = resample.clustered_cells(t, "gene", "len", F.col("x"), F.col("hit"))
    return resample.percentile_interval(resample.clustered_bootstrap(cells, spark))


@query()
def permutation_null(spark, d):
    t = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), F.lit("all").alias("stratum"), F.col("s_nationkey").cast("string").alias("label"), (F.col("s_suppkey") % 25).cast("string").alias("target"))
    return resample.permutation_null(spark, t, C.PERMUTATIONS, 0)


@query()
def shuffle_null(spark, d):
    q = B.occurrences(spark, d).select("seq").distinct().select(resample.shuffled(F.col("seq"), 7).alias("seq")).distinct()
    return sequence.contained(q, B.references(spark, d), lengths=B.LENGTHS).agg(F.count("*").alias("n"))


from veristrata.plans import files, inference  # noqa: E402, F401  they add their queries
