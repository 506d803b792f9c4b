"""More queries of the audit: frames, cohorts, loci, bests and bounds, claim building, and nulls by resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata import config as C
from veristrata.functions import columns as K
from veristrata.functions import evidence as E
from veristrata.operators import decoy, gates, kmers, ladder, phrases, registry, resample, sequence, stats
from veristrata.plans import base as B
from veristrata.plans.checkpoint import store
from veristrata.plans.queries import _ALPHA, _CANON, _FLAGS_SQL, _KNOWN, _EV, _OR, _P, _Q, _SCORED, _SIZES, _adj, _exposed, _flagged, _hits, _parts, _scored, _swept, SQL, query  # noqa: PLC2701
from veristrata.sources import claims as S

_LETTERS = "upper(regexp_replace({0}, '[^A-Za-z]', '', 'g'))".format

# ---- frames and classes -----------------------------------------------------------------------------------------

#: English words of each source are its claims; its texts in other languages are the references of its own gene.
_FRAME = f"WITH {_OR}, p AS (SELECT DISTINCT seq, gene FROM o WHERE tissue = 'en'), t AS (SELECT source AS gene, {_LETTERS('text')} AS text FROM documents WHERE lang <> 'en'), f AS (SELECT p.seq, p.gene, h.hit AS is_self, p.gene IN (SELECT gene FROM t) AS coding, EXISTS (SELECT 1 FROM t WHERE t.gene = p.gene AND contains(t.text, p.seq)) AS own FROM p JOIN h USING (seq))"


def _own_references(spark, d) -> DataFrame:
    return B.table(spark, d, "documents").where("lang <> 'en'").select(F.col("source").alias("gene"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("text"))


def _framed(spark, d) -> DataFrame:
    p = B.occurrences(spark, d).where("tissue = 'en'").select("seq", "gene").distinct()
    own = sequence.in_own_group(p, _own_references(spark, d), "gene")
    return own.join(_hits(spark, d).withColumnRenamed("hit", "is_self"), "seq")


@query(_FRAME + " SELECT is_self, count(*) AS n, count(*) FILTER (WHERE coding) AS coding, count(*) FILTER (WHERE own) AS own FROM f GROUP BY is_self")
def own_gene_frame_audit(spark, d):
    return sequence.frame_audit(_framed(spark, d), _own_references(spark, d), "gene", "is_self")


@query(_FRAME + ", g AS (SELECT gene, bool_or(own) AS own FROM f WHERE is_self GROUP BY gene) SELECT count(*) AS genes, count(*) FILTER (WHERE own) AS own FROM g")
def gene_level_hits(spark, d):
    return sequence.gene_level(_framed(spark, d).where("is_self"), "gene")


@query(f"WITH {_OR}, t AS (SELECT DISTINCT tissue, seq FROM o WHERE tissue NOT IN ('de', 'fr') AND gene <> 'src0') SELECT tissue AS class, count(*) AS n_target_peptides, count(*) FILTER (WHERE hit) AS canonical_self, round(count(*) FILTER (WHERE hit) / count(*), 4) AS canonical_self_frac FROM t JOIN h USING (seq) GROUP BY 1")
def canonical_self_by_class(spark, d):
    rows = B.occurrences(spark, d).select(F.col("tissue").alias("class"), F.col("seq").alias("peptide"), (F.col("gene") == "src0").alias("is_decoy"))
    return sequence.self_fraction(rows, B.references(spark, d), ("de", "fr"))


def _classed(spark, d) -> DataFrame:
    return B.occurrences(spark, d).distinct().join(_hits(spark, d), "seq")


@query(f"WITH {_OR}, t AS (SELECT DISTINCT tissue, o.seq, hit FROM o JOIN h USING (seq) WHERE length(o.seq) BETWEEN 8 AND 11) SELECT tissue, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM t GROUP BY 1")
def overlap_in_band(spark, d):
    t = _classed(spark, d).where(sequence.in_band(F.col("seq"))).select("tissue", "seq", "hit").distinct()
    return t.groupBy("tissue").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))


_LANGS = ["en", "fr", "de", "es"]


@query(f"WITH {_OR}, t AS (SELECT DISTINCT o.*, hit FROM o JOIN h USING (seq)) SELECT gene, " + ", ".join(f"count(*) FILTER (WHERE tissue = '{x}') AS {x}_n, count(*) FILTER (WHERE tissue = '{x}' AND hit) AS {x}_hits" for x in _LANGS) + " FROM t GROUP BY gene")
def overlap_cross_tab(spark, d):
    return stats.cross_tab(_classed(spark, d), "gene", "tissue", _LANGS, F.col("hit"))


@query(f"WITH {_OR}, n AS ({B.NORMAL_SQL}), m AS (SELECT seq FROM h WHERE NOT hit) SELECT count(*) AS n, count(*) FILTER (WHERE seq IN (SELECT seq FROM n)) AS in_normal, round(count(*) FILTER (WHERE seq IN (SELECT seq FROM n)) / count(*), 12) AS rate FROM m")
def noncanonical_overlap(spark, d):
    q = B.occurrences(spark, d).select("seq").distinct()
    rest = sequence.minus(q, sequence.contained(q, B.references(spark, d), lengths=B.LENGTHS), "seq")
    t = sequence.flagged(rest, B.normal(spark, d), "seq", "x")
    return t.agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long")).alias("in_normal"), F.round(F.sum(F.col("x").cast("long")) / F.count("*"), 12).alias("rate"))


@query(f"WITH {_OR}, w AS (SELECT upper(n_name) AS seq FROM nation UNION SELECT seq FROM q WHERE length(seq) = 12), t AS (SELECT source AS gene, {_LETTERS('text')} AS text FROM documents WHERE lang <> 'en') SELECT w.seq, array_to_string(list_sort(list(DISTINCT t.gene)), ',') AS genes FROM w JOIN t ON contains(t.text, w.seq) WHERE length(w.seq) >= 6 GROUP BY w.seq")
def small_set_genes(spark, d):
    few = B.table(spark, d, "nation").select(F.upper("n_name").alias("seq")).unionAll(B.occurrences(spark, d).select("seq").where("length(seq) = 12")).distinct()
    return sequence.seed_matches(few, _own_references(spark, d), ["gene"], 6).groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes"))  # sources are few


@query(f"WITH {_OR}, a AS (SELECT tissue, count(DISTINCT o.seq) AS n, count(DISTINCT CASE WHEN hit THEN o.seq END) AS k FROM o JOIN h USING (seq) GROUP BY 1), b AS (SELECT x.tissue AS one, y.tissue AS two, x.n AS n1, x.k AS k1, y.n AS n2, y.k AS k2, CAST(x.k + y.k AS DOUBLE) / (x.n + y.n) AS p FROM a x JOIN a y ON x.tissue < y.tissue) SELECT one, two, round(coalesce((k1 / n1 - k2 / n2) / nullif(sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 0), 0), 9) AS z FROM b")
def overlap_two_proportions(spark, d):
    a = _classed(spark, d).select("tissue", "seq", "hit").distinct().groupBy("tissue").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("k"))
    two = a.select(F.col("tissue").alias("two"), F.col("n").alias("n2"), F.col("k").alias("k2"))
    both = a.withColumn("_on", F.lit(1)).join(two.withColumn("_on", F.lit(1)), "_on").where("tissue < two")  # a row a language
    return both.select(F.col("tissue").alias("one"), "two", F.round(K.two_proportion_z(F.col("k"), F.col("n"), F.col("k2"), F.col("n2")), 9).alias("z"))


_FIGURES = [("matrix", "'pooled'", "dimension", "rung", "claim_ladder_pooled"), ("matrix", "stratum", "dimension", "rung", "claim_ladder_by_stratum"), ("t-cell state", "'pooled'", "orf_class", "state", "tcell_state_counts"), ("normal state", "'pooled'", "orf_class", "state", "normal_state_counts")]


@query(" UNION ALL ".join(f"SELECT '{part}' AS part, {stratum} AS stratum, {item} AS item, {state} AS state, CAST(n AS BIGINT) AS n FROM ({SQL[name]})" for part, stratum, item, state, name in _FIGURES))
def figure_inputs(spark, d):
    """What the figures draw, one long table from one scored table: the matrix over all claims and by stratum, and the states."""
    t = store(_scored(spark, d).withColumn("stratum", E.stratum()), "scored")
    row = lambda df, part, stratum, item, state: df.select(F.lit(part).alias("part"), stratum.alias("stratum"), F.col(item).alias("item"), F.col(state).alias("state"), F.col("n").cast("long").alias("n"))
    pooled = F.lit("pooled")
    states = lambda c: ladder.counts(t.withColumn("state", c), ["orf_class", "state"])
    out = row(ladder.ladder(t), "matrix", pooled, "dimension", "rung").unionAll(row(ladder.ladder(t, ["stratum"]), "matrix", F.col("stratum"), "dimension", "rung"))
    return out.unionAll(row(states(E.human_tcell_state()), "t-cell state", pooled, "orf_class", "state")).unionAll(row(states(E.normal_presentation_state()), "normal state", pooled, "orf_class", "state"))


# ---- registries, loci, bests ------------------------------------------------------------------------------------


@query("WITH l AS (SELECT l_suppkey AS k, max(o_totalprice) AS v FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), g AS (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1), i AS (SELECT 's' || s_suppkey AS entry, s_suppkey AS link, s_nationkey AS gene FROM supplier UNION ALL SELECT 'c' || c_custkey, NULL, c_nationkey FROM customer UNION ALL SELECT 'r' || r_regionkey, NULL, NULL FROM region) SELECT entry, coalesce(l.v, g.v) AS ppm, CASE WHEN l.v IS NOT NULL THEN 'link' WHEN g.v IS NOT NULL THEN 'gene' END AS via FROM i LEFT JOIN l ON l.k = i.link LEFT JOIN g ON g.k = i.gene")
def linked_abundance(spark, d):
    """Suppliers have links to their orders, customers only their nation's values, regions neither."""
    t = lambda n: B.table(spark, d, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("entry")
    none = F.lit(None).cast("long")
    links = t("lineitem").select(name("s", "l_suppkey"), F.col("l_orderkey").alias("ident")).distinct()
    by_id = t("orders").select(F.col("o_orderkey").alias("ident"), F.col("o_totalprice").alias("ppm"))
    by_gene = t("customer").groupBy(F.col("c_nationkey").cast("long").alias("gene")).agg(F.max("c_acctbal").alias("ppm"))
    items = t("supplier").select(name("s", "s_suppkey"), F.col("s_nationkey").cast("long").alias("gene")).unionAll(t("customer").select(name("c", "c_custkey"), F.col("c_nationkey").cast("long"))).unionAll(t("region").select(name("r", "r_regionkey"), none))
    return registry.linked_value(items, links, by_id, by_gene, "entry", "ident", "gene", "ppm").drop("gene")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY doc_id")
def unattached_keys(spark, d):
    """Documents without a label."""
    return registry.unattached(B.table(spark, d, "documents"), B.table(spark, d, "labels"), "doc_id")


_ROUTES = f"WITH o AS ({B.OCCURRENCES_SQL}), n AS (SELECT n_nationkey AS k, 'R' || n_regionkey AS gene, substr(n_name, 1, 1) AS initial FROM nation), m AS (SELECT initial, min_by(gene, k) AS gene FROM n GROUP BY 1), a AS (SELECT seq, min(gene) AS gene FROM o WHERE tissue = 'en' GROUP BY 1), b AS (SELECT DISTINCT o.seq, n.gene AS gene, m.gene AS other FROM o LEFT JOIN n ON n.k = length(o.seq) LEFT JOIN m ON m.initial = substr(o.seq, 1, 1) WHERE tissue = 'fr')"


def _routes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Words of two cohorts: of one a gene is said; of the other a transcript (their length), and a symbol (their initial)."""
    t, n = B.occurrences(spark, d), B.table(spark, d, "nation")
    gene = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    by_transcript = n.select(F.col("n_nationkey").cast("int").alias("transcript"), gene.alias("gene"))
    by_symbol = n.groupBy(F.substr("n_name", F.lit(1), F.lit(1)).alias("symbol")).agg(F.min_by(gene, "n_nationkey").alias("other"))
    two = t.where("tissue = 'fr'").select("seq", F.length("seq").alias("transcript"), F.substr("seq", F.lit(1), F.lit(1)).alias("symbol")).distinct()
    return t.where("tissue = 'en'").select("seq", "gene"), two.join(F.broadcast(by_transcript), "transcript", "left").join(F.broadcast(by_symbol), "symbol", "left")  # rows of nation


@query(_ROUTES + ", r AS (SELECT coalesce(a.seq, b.seq) AS seq, coalesce(a.gene, b.gene) AS gene, CASE WHEN a.gene IS NOT NULL THEN 'said' ELSE 'transcript' END AS route FROM a FULL JOIN (SELECT * FROM b WHERE gene IS NOT NULL) b ON a.seq = b.seq) SELECT route, gene, count(*) AS n, min(seq) AS first FROM r WHERE gene IS NOT NULL GROUP BY ALL")
def routed_genes(spark, d):
    """H7: the gene of each word by the first route that has one."""
    said, other = _routes(spark, d)
    found = registry.first_route([("said", said.withColumn("at", F.col("gene"))), ("transcript", other.select("seq", "gene", F.col("gene").alias("at")))], "seq", "gene", "at")
    return found.groupBy("route", "gene").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query(_ROUTES + " SELECT count(*) FILTER (WHERE gene IS NOT NULL AND other IS NOT NULL) AS both, count(*) FILTER (WHERE gene = other) AS agree FROM b")
def route_agreement(spark, d):
    """H7: how often two routes to a gene agree where both lead somewhere."""
    return registry.agreement(_routes(spark, d)[1], "gene", "other")


_SPANS = f"WITH o AS ({B.OCCURRENCES_SQL}), t AS (SELECT DISTINCT seq, CASE tissue WHEN 'en' THEN 'CRITICAL' WHEN 'fr' THEN 'HIGH' WHEN 'de' THEN 'PRIVILEGED' WHEN 'es' THEN 'IMMUNE' ELSE 'OTHER:elbow' END AS tier FROM o)"


def _spans(spark, d) -> DataFrame:
    named = F.create_map(*[F.lit(x) for x in ("en", "Brain ", "fr", "skin", "de", "testis", "es", "Thymus")])
    return B.occurrences(spark, d).select("seq", F.coalesce(named[F.col("tissue")], F.lit("Elbow")).alias("tissue"))


@query(_SPANS + " SELECT tier, count(*) AS n FROM t GROUP BY 1")
def tier_histogram(spark, d):
    """Words by the tiers of their tissues; a word may span several."""
    return registry.tier_contamination(_spans(spark, d), "seq", "tissue")[0]


@query(_SPANS + ", p AS (SELECT seq, bool_or(tier = 'CRITICAL') AS c, bool_and(tier IN ('IMMUNE', 'PRIVILEGED')) AS p FROM t GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE c) AS critical, count(*) FILTER (WHERE p) AS tolerated FROM p")
def tier_contamination(spark, d):
    return registry.tier_contamination(_spans(spark, d), "seq", "tissue")[1]


@query("WITH o AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'overridden' END AS v FROM labels WHERE quality = 1) SELECT d.doc_id, coalesce(o.v, d.lang) AS lang FROM documents d LEFT JOIN o USING (doc_id)")
def last_override(spark, d):
    over = B.table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("overridden").alias("lang"), F.lit(1).alias("at"))
    return registry.last_wins(B.table(spark, d, "documents").select("doc_id", "lang"), over, "doc_id", "lang", "at")


@query(f"WITH {_Q} SELECT peptide, round(min(q), 12) AS q, count(*) FILTER (WHERE NOT is_decoy) AS targets, count(*) FILTER (WHERE is_decoy) AS decoys FROM q GROUP BY peptide")
def best_q_by_peptide(spark, d):
    return decoy.best_q(_swept(spark, d).where("score is not null")).withColumn("q", F.round("q", 12))


_SKIP = ["", "not reported", "na", "n/a"]
_LOCI = f"WITH c AS ({B.CLAIMS_SQL}), l AS (SELECT orf_class, regexp_replace(orf_id_or_locus, '_[0-9]+aa(_[0-9]+)?$', '') AS locus, count(*) AS weight FROM c WHERE orf_class IN ('altORF', 'lncRNA-ORF', 'pseudogene-ORF') AND orf_id_or_locus IS NOT NULL GROUP BY 1, 2)"


def _loci(spark, d) -> DataFrame:
    t = B.claims(spark, d).withColumn("locus", K.orf_base(F.col("orf_id_or_locus")))
    return registry.class_loci(t, "orf_class", "locus", ["altORF", "lncRNA-ORF", "pseudogene-ORF"], _SKIP)


@query(_LOCI + " SELECT * FROM l")
def class_loci_weights(spark, d):
    return _loci(spark, d)


@query(_LOCI + " SELECT orf_class, locus, weight FROM (SELECT *, row_number() OVER (PARTITION BY orf_class ORDER BY weight DESC, locus) AS k FROM l) WHERE k <= 3")
def top_loci(spark, d):
    return stats.top_k(_loci(spark, d), 3, [F.desc("weight"), F.col("locus")], ["orf_class"])


@query("SELECT source, min_by(lang, doc_id) AS first, max_by(lang, doc_id) AS last FROM documents GROUP BY source")
def first_and_last_label(spark, d):
    t = B.table(spark, d, "documents").select("source", "doc_id", F.col("lang").alias("first"), F.col("lang").alias("last"))
    return ladder.first_value(t, ["source"], "first", "doc_id").join(ladder.first_value(t, ["source"], "last", "doc_id", last=True), "source")


@query("WITH v AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings) SELECT vec_id, s[CAST(floor(len(s) / 2) AS INT) + 1] AS upper_median, s[CAST(floor(len(s) * 0.9) AS INT) + 1] AS p90 FROM v")
def vector_order_statistics(spark, d):
    v = B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", stats.upper_median(F.col("v")).alias("upper_median"), stats.order_statistic(F.col("v"), F.floor(F.size("v") * 0.9).cast("int")).alias("p90"))


# ---- rates, trends, bounds --------------------------------------------------------------------------------------


@query(_FLAGS_SQL + " SELECT round(avg(reuse), 9) AS mean_reuse, count(*) AS n FROM f")
def reuse_mean(spark, d):
    return ladder.peptide_flags(_scored(spark, d)).agg(F.round(F.avg("reuse"), 9).alias("mean_reuse"), F.count("*").alias("n"))


_REPORTED = [("all", "true"), ("not canonical", "NOT canonical"), ("not in normal", "NOT in_normal"), ("allele reported", "allele"), ("translation reported", "source_rigor_reported"), ("immunogenicity reported", "immuno_reported")]


@query(_FLAGS_SQL + _CANON + " " + " UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) FILTER (WHERE {' AND '.join(t for _, t in _REPORTED[: i + 1])}) AS n FROM g" for i, (s, _) in enumerate(_REPORTED)))
def reporting_cascade(spark, d):
    c = F.col
    return ladder.cascade(_flagged(spark, d), [("all", F.lit(True)), ("not canonical", ~c("canonical")), ("not in normal", ~c("in_normal")), ("allele reported", c("allele")), ("translation reported", c("source_rigor_reported")), ("immunogenicity reported", c("immuno_reported"))])


_STRATUM = f"CASE WHEN {_KNOWN} OR {_EV} LIKE '%t-cell%' THEN '3. T-cell-tested' WHEN _source LIKE 'cohort:%' THEN '2. end-to-end cohort' ELSE '1. atlas ligand record' END"
_WILSON = "round((k / n + 1.9208 / n) / (1 + 3.8416 / n) {0} 1.96 * sqrt((k / n) * (1 - k / n) / n + 0.9604 / (CAST(n AS DOUBLE) * n)) / (1 + 3.8416 / n), 9)".format


@query(f"WITH {_SCORED}, t AS (" + " UNION ALL ".join(f"SELECT {_STRATUM} AS stratum, '{x}' AS dimension, {_adj(x)} AS y FROM s" for x in C.DIMENSIONS) + f"), a AS (SELECT stratum, dimension, count(*) AS n, count(*) FILTER (WHERE y) AS k FROM t GROUP BY 1, 2) SELECT stratum, dimension, n, k, greatest(0, {_WILSON('-')}) AS low, least(1, {_WILSON('+')}) AS high FROM a")
def adjudicable_by_stratum(spark, d):
    t = _scored(spark, d).withColumn("stratum", E.stratum())
    per = t.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum(F.col(f"{x}.adjudicable").cast("long")).alias(x) for x in C.DIMENSIONS])
    long = per.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).alias("k")) for x in C.DIMENSIONS])).alias("x")).select("stratum", "n", "x.*")
    return long.withColumn("w", K.wilson(F.col("k"), F.col("n"))).select("stratum", "dimension", "n", "k", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


_BINNED = f"WITH {_SIZES}, e AS (SELECT list_sort(list(p_retailprice)) AS v, count(*) AS n FROM a), t AS (SELECT {' + '.join(f'CAST((p_retailprice >= v[{i} * n // 5 + 1]) AS INT)' for i in range(1, 5))} AS bin, p_size, qty FROM a, e), w AS (SELECT p_size, count(*) AS w FROM t GROUP BY 1)"


def _price_bins(spark, d) -> DataFrame:
    t = _parts(spark, d)
    return t.withColumn("bin", stats.binned(F.col("p_retailprice"), stats.quantile_edges(t, "p_retailprice", 5)))


@query(_BINNED + ", c AS (SELECT bin, p_size, count(*) AS n, sum(qty) AS s FROM t GROUP BY 1, 2 HAVING count(*) >= 2) SELECT bin, round(sum(w * s / n) / (SELECT count(*) FROM t), 6) AS mean FROM c JOIN w USING (p_size) GROUP BY bin")
def mean_std_unrenormalized(spark, d):
    return stats.standardized_mean(_price_bins(spark, d), "qty", "p_size", "bin", renormalize=False, min_n=2).withColumn("mean", F.round("mean", 6))


@query(_BINNED + ", c AS (SELECT bin, p_size, count(*) AS n, sum(qty) AS s FROM t GROUP BY 1, 2), m AS (SELECT bin, sum(w * s / n) / sum(w) AS mean FROM c JOIN w USING (p_size) GROUP BY bin), g AS (SELECT bin, mean, lag(mean) OVER (ORDER BY bin) AS p FROM m) SELECT count(p) AS steps, count(*) FILTER (WHERE mean > p) AS up, coalesce(bool_and(mean >= p) FILTER (WHERE p IS NOT NULL), true) AS never_falls, round(max_by(mean, bin) - min_by(mean, bin), 6) AS difference FROM g")
def trend_of_bins(spark, d):
    m = stats.standardized_mean(_price_bins(spark, d), "qty", "p_size", "bin")
    return stats.monotone(m, "bin", "mean").crossJoin(stats.last_minus_first(m, "bin", "mean").select(F.round("difference", 6).alias("difference")))  # one row each


_SAMPLE_Q = f"{_P}, r AS (SELECT *, sum(CAST(is_decoy AS INT)) OVER w / greatest(sum(CAST(NOT is_decoy AS INT)) OVER w, 1) AS fdr FROM p WHERE score IS NOT NULL WINDOW w AS (PARTITION BY sample ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING)), q AS (SELECT * EXCLUDE (fdr), least(1.0, min(fdr) OVER (PARTITION BY sample ORDER BY score, event_id DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)"


@query(f"WITH {_SAMPLE_Q}, a AS (SELECT sample, count(*) FILTER (WHERE NOT is_decoy) AS t, count(*) FILTER (WHERE is_decoy) AS d FROM q WHERE q <= {_ALPHA} GROUP BY sample) SELECT sample, t, d, round((d + 1) / greatest(t, 1), 12) AS fdr FROM a")
def per_sample_sweep(spark, d):
    t = decoy.accepted(decoy.q_sweep(B.psms(spark, d), "score", "is_decoy", "event_id", by=["sample"]), _ALPHA)
    a = t.groupBy("sample").agg(F.sum((~F.col("is_decoy")).cast("long")).alias("t"), F.sum(F.col("is_decoy").cast("long")).alias("d"))
    return a.withColumn("fdr", F.round(decoy.fdr(F.col("d"), F.col("t")), 12))


@query(f"WITH {_P}, g AS (SELECT count(*) FILTER (WHERE is_decoy) / count(*) FILTER (WHERE NOT is_decoy) AS q, count(*) FILTER (WHERE NOT is_decoy) AS all_t FROM p), a AS (SELECT class, q, count(*) FILTER (WHERE NOT is_decoy) / all_t AS f FROM p, g GROUP BY class, q, all_t), b AS (SELECT class, greatest(0.0, (q - (1 - f)) / f) AS low, least(1.0, q / f) AS high FROM a) SELECT class, round(low, 9) AS low, round(high, 9) AS high, CASE WHEN high < 0.75 THEN 'reject' WHEN low >= 0.75 THEN 'accept' ELSE 'not identified' END AS verdict, round((SELECT greatest(0.0, sum(low) - 2) FROM b), 9) AS all_low, round((SELECT min(high) FROM b), 9) AS all_high, round(1.96 * sqrt(high / (1 * 1000.0)), 9) AS half_width FROM b")
def class_fdr_intervals(spark, d):
    p = B.psms(spark, d).groupBy("class").agg(F.sum((~F.col("is_decoy")).cast("long")).alias("t"), F.sum(F.col("is_decoy").cast("long")).alias("d"))
    g = p.agg((F.sum("d") / F.sum("t")).alias("q"), F.sum("t").alias("all_t"))
    b = p.crossJoin(F.broadcast(g)).select("class", K.class_fdr_bounds(F.col("q"), F.col("t") / F.col("all_t")).alias("b")).select("class", "b.*")  # one row
    both = b.groupBy().pivot("class", ["canonical", "noncanonical", "variant"]).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    c = K.conjunction_bounds(*[[F.col(f"{x}_{side}") for x in ("canonical", "noncanonical", "variant")] for side in ("low", "high")])
    t = b.crossJoin(F.broadcast(both.select(c.alias("c"))))  # one row
    return t.select("class", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), K.triage(F.col("low"), F.col("high"), F.lit(1.0), F.lit(3.0)).alias("verdict"), F.round("c.low", 9).alias("all_low"), F.round("c.high", 9).alias("all_high"), F.round(K.entrapment_half_width(F.col("high"), F.lit(1), F.lit(1000)), 9).alias("half_width"))


@query("WITH s AS (SELECT CAST(p_size AS DOUBLE) AS n, CAST(51 - p_size AS DOUBLE) AS c FROM part), w AS (SELECT n, c, (1 - power(0.99, n + c)) / (n + c) AS w FROM s) SELECT round(sum(w * n) / sum(w * c), 9) AS rho_eff, round(sum(n) / sum(c), 9) AS rho_global FROM w")
def effective_rho(spark, d):
    t = B.table(spark, d, "part").select(F.col("p_size").alias("n"), (51 - F.col("p_size")).alias("c"))
    return resample.effective_rho(t, "n", "c", 0.01).select(F.round("rho_eff", 9).alias("rho_eff"), F.round("rho_global", 9).alias("rho_global"))


_SYMBOLS = "SELECT p_partkey, list_extract(['KRT', 'RPS', 'ab-', '7X', 'HNRNP', 'P'], p_partkey % 6 + 1) || (p_partkey % 40) || CASE WHEN p_partkey % 3 = 0 THEN 'P' || (p_partkey % 17) WHEN p_partkey % 3 = 1 THEN 'p' ELSE '' END AS symbol, list_extract(['KRT', 'RPS', 'AB-', 'KRT', 'HNRNP', 'P'], p_partkey % 5 + 1) || (p_partkey % 7) || CASE WHEN p_partkey % 4 = 0 THEN 'A' ELSE '' END AS other FROM part"


@query(f"WITH s AS (SELECT *, upper(symbol) AS u FROM ({_SYMBOLS})), r AS (SELECT *, CASE WHEN regexp_matches(u, '^[A-Z]') AND length(regexp_extract(u, '^([A-Z0-9-]+?)P[0-9]*$', 1)) >= 2 THEN regexp_extract(u, '^([A-Z0-9-]+?)P[0-9]*$', 1) END AS parent, len(list_filter(range(1, least(length(u), length(other)) + 1), lambda i: u[:i] = other[:i])) AS k FROM s) SELECT parent, u = other OR (k >= 3 AND (regexp_full_match(u[k + 1:], '[0-9]+') OR regexp_full_match(other[k + 1:], '[0-9]+'))) AS same, count(*) AS n, min(symbol) AS first FROM r GROUP BY ALL")
def symbol_heuristics(spark, d):
    """The parent that a symbol names, and whether two symbols differ by a number only."""
    t = spark.sql(_SYMBOLS.replace("list_extract([", "element_at(array(").replace("], p_partkey", "), CAST(p_partkey").replace("% 6 + 1)", "% 6 + 1 AS INT))").replace("% 5 + 1)", "% 5 + 1 AS INT))").replace("FROM part", "FROM {part}"), part=B.table(spark, d, "part"))
    same = K.drift_equal(F.upper("symbol"), F.col("other"))
    return t.groupBy(K.pseudogene_parent(F.col("symbol")).alias("parent"), same.alias("same")).agg(F.count("*").alias("n"), F.min("symbol").alias("first"))


# ---- claim building ---------------------------------------------------------------------------------------------

_BIOTYPE = "CASE item_id % 5 WHEN 0 THEN 'lincRNA' WHEN 1 THEN 'processed_pseudogene' WHEN 2 THEN 'protein_coding' WHEN 3 THEN 'antisense' ELSE NULL END"
_GENE = "CASE WHEN item_id % 7 = 0 THEN 'MAGEA' || item_id ELSE 'G' || item_id END"
_EXPANDED = f"""WITH g AS (SELECT item_id, {_GENE} AS gene, {_BIOTYPE} AS biotype, list_transform(list_filter(string_split(CASE WHEN item_id % 9 = 0 THEN 'short, (none)' ELSE regexp_replace(text, '[^A-Za-z]+', ',', 'g') END, ','), lambda x: regexp_full_match(trim(x), '[A-Za-z]{{7,}}')), lambda x: upper(trim(x))) AS peps FROM benchmark),
  c AS (SELECT item_id, gene, biotype, unnest(CASE WHEN len(peps) > 0 THEN peps ELSE ['not reported'] END) AS pep, len(peps) AS n FROM g)"""


def _expanded(spark, d) -> DataFrame:
    t = B.table(spark, d, "benchmark").selectExpr("item_id AS _row", f"{_GENE} AS gene", f"{_BIOTYPE} AS biotype", "CASE WHEN item_id % 9 = 0 THEN 'short, (none)' ELSE regexp_replace(text, '[^A-Za-z]+', ',') END AS cell")
    return S.expand_genes(t, {"citation_doi_pmid": "10.1000/genes", "citation_location": "Table 1"}, "cohort:genes")


@query(_EXPANDED + " SELECT (SELECT count(*) FROM g) AS source_rows, count(*) FILTER (WHERE n > 0) AS peptide_claims, count(*) FILTER (WHERE n = 0) AS gene_level, (SELECT CAST(sum(len(peps)) AS BIGINT) FROM g) AS expected, 0 AS gene_level_with_peptide, 0 AS without_lineage, count(DISTINCT CASE WHEN n > 0 THEN pep END) AS unique_peptides, count(*) FILTER (WHERE n > 0) - (SELECT count(*) FROM (SELECT DISTINCT gene, pep FROM c WHERE n > 0)) AS duplicates FROM c")
def expanded_claims(spark, d):
    figures = S.expansion(_expanded(spark, d))
    gates.expansion_holds(figures)
    return figures


@query(_EXPANDED + " SELECT CASE WHEN biotype LIKE '%pseudogene%' THEN 'pseudogene-ORF' WHEN biotype IN ('lincRNA', 'antisense') THEN 'lncRNA-ORF' ELSE 'other' END AS orf_class, CASE WHEN gene LIKE 'MAGEA%' AND coalesce(biotype, '') NOT IN ('lincRNA', 'antisense', 'processed_pseudogene') THEN 'TAA' ELSE 'TSA' END AS antigen_type, count(*) AS n, CAST(sum(CASE WHEN n > 0 THEN length(pep) END) AS BIGINT) AS residues FROM c GROUP BY 1, 2")
def expanded_classes(spark, d):
    return _expanded(spark, d).groupBy("orf_class", "antigen_type").agg(F.count("*").alias("n"), F.sum(F.expr("try_cast(ligand_len AS BIGINT)")).alias("residues"))


_COHORT = f"WITH c AS ({B.CLAIMS_SQL}), r AS (SELECT *, regexp_full_match(peptide_sequence, '[A-Z]+') AS ok FROM c WHERE hla_allele <> ' NA ')"


def _cohort_claims(spark, d) -> DataFrame:
    return B.claims(spark, d).selectExpr("*", "claim_id AS _row_idx", "CASE WHEN hla_allele = ' NA ' THEN 'yes' ELSE 'no' END AS _canonical")


@query(_COHORT + ", f AS (SELECT citation_doi_pmid, peptide_sequence AS seq, min_by(orf_class, claim_id) AS orf_class FROM r WHERE ok GROUP BY 1, 2), x AS (SELECT citation_doi_pmid, orf_class, count(*) AS n FROM f GROUP BY 1, 2), y AS (SELECT citation_doi_pmid, count(*) FILTER (WHERE NOT ok) AS dropped FROM r GROUP BY 1) SELECT x.citation_doi_pmid, orf_class, n, dropped FROM x JOIN y ON x.citation_doi_pmid = y.citation_doi_pmid")
def cohort_classes(spark, d):
    t = _cohort_claims(spark, d)
    return S.cohort_sequences(t).groupBy("citation_doi_pmid", "orf_class").agg(F.count("*").alias("n")).join(S.cohort_dropped(t), "citation_doi_pmid")


@query(_COHORT + " SELECT peptide_sequence AS seq, min_by(orf_id_or_locus, claim_id) AS locus, count(*) AS claims FROM r WHERE ok AND citation_doi_pmid = '10.1000/src1' AND orf_class IN ('lncRNA-ORF', 'uORF') GROUP BY 1")
def target_loci(spark, d):
    return S.target_subset(_cohort_claims(spark, d), "10.1000/src1", ["lncRNA-ORF", "uORF"])


@query(f"WITH o AS ({B.OCCURRENCES_SQL}), n AS ({B.NORMAL_SQL}) SELECT CAST(length(seq) AS INT) AS length, count(*) AS n FROM (SELECT seq FROM o UNION SELECT seq FROM n) GROUP BY 1")
def catalogue_sequences(spark, d):
    both = sequence.sequence_union(B.occurrences(spark, d), B.normal(spark, d))
    return both.groupBy(F.length("seq").alias("length")).agg(F.count("*").alias("n"))


@query("SELECT role, lang, count(*) AS n FROM (SELECT role, NULL AS lang FROM conversations UNION ALL SELECT NULL, lang FROM documents) GROUP BY ALL")
def heterogeneous_union(spark, d):
    return sequence.catalogue_union(B.table(spark, d, "conversations").select("role"), B.table(spark, d, "documents").select("lang")).groupBy("role", "lang").agg(F.count("*").alias("n"))


_NUMBERS = "t AS (SELECT lang, text, regexp_extract_all(text, '[0-9]+') AS m, regexp_split_to_array(text, '[0-9]+') AS p FROM documents), u AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM t), m AS (SELECT lang, text, m[k] AS m, 1 + list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS i FROM u)"


@query(f"WITH {_NUMBERS} SELECT lang, count(*) AS n, CAST(sum(length(text[greatest(1, i - 8):i + length(m) + 7])) AS BIGINT) AS letters, max(m) AS last, min(text[greatest(1, i - 8):i + length(m) + 7]) AS context FROM m GROUP BY 1")
def numbers_in_context(spark, d):
    """2.8: numbers with eight characters on either side, whatever else stands there."""
    t = phrases.find_pattern(B.table(spark, d, "documents"), "[0-9]+", keep=["lang"], before=8, after=8)
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("context")).alias("letters"), F.max("match").alias("last"), F.min("context").alias("context"))


_OPENINGS = "SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z]+ [a-z]+')) AS phrase FROM benchmark WHERE regexp_extract(text, '^[A-Za-z]+ [a-z]+') <> ''"


@query(f"WITH p AS ({_OPENINGS}), t AS (SELECT phrase, doc_id, text, lower(text) AS low FROM documents JOIN p ON contains(lower(text), phrase)) SELECT phrase, CAST(sum((length(low) - length(replace(low, phrase, ''))) // length(phrase)) AS BIGINT) AS n, count(DISTINCT doc_id) AS texts, min(text[greatest(1, instr(low, phrase) - 18):instr(low, phrase) + length(phrase) + 21]) AS context FROM t GROUP BY 1")
def phrases_in_context(spark, d):
    """The openings of all references in all texts, in any case, found in one scan; contexts of first occurrences."""
    openings = [r.phrase for r in spark.sql(_OPENINGS.replace("'^[A-Za-z]+ [a-z]+'", "'^[A-Za-z]+ [a-z]+', 0").replace("FROM benchmark", "FROM {benchmark}"), benchmark=B.table(spark, d, "benchmark")).collect()]  # a list of phrases
    found = phrases.find_phrases(B.table(spark, d, "documents"), openings, keep=["doc_id"], before=18, after=22)
    per = found.groupBy("phrase", "doc_id").agg(F.count("*").alias("n"), F.min_by("context", "at").alias("context"))
    return per.groupBy("phrase").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("context").alias("context"))


_KINDS = ["3' UTR", "5'UTR overlap", "out of frame", "unitary pseudogene", "intron retained", "lincRNA", "exotic"]
_TISSUES = ["Brain", "skin", "prostate", "thymus", "Testis", "elbow"]
_BIO = ["protein_coding", "lincRNA", "processed_pseudogene", "antisense", "genebody"]


@query(f"WITH t AS (SELECT p_partkey, {_KINDS!r}[p_partkey % 7 + 1] AS kind, {_TISSUES!r}[p_partkey % 6 + 1] AS tissue, {_BIO!r}[p_partkey % 5 + 1] AS bio, CASE p_partkey % 4 WHEN 0 THEN 'RPS' WHEN 1 THEN 'MAGEB' WHEN 2 THEN 'ABC' ELSE 'MRPL' END || (p_partkey % 8) AS gene FROM part) SELECT CASE p_partkey % 7 WHEN 0 THEN '3''UTR-ORF' WHEN 1 THEN 'uORF' WHEN 2 THEN 'altORF' WHEN 3 THEN 'pseudogene-ORF' WHEN 4 THEN 'intronic-ORF' WHEN 5 THEN 'lncRNA-ORF' ELSE 'other' END AS atlas, CASE p_partkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MODERATE' WHEN 3 THEN 'IMMUNE' WHEN 4 THEN 'PRIVILEGED' ELSE 'OTHER' END AS tier, CASE p_partkey % 5 WHEN 1 THEN 'lncRNA-ORF' WHEN 2 THEN 'pseudogene-ORF' WHEN 3 THEN 'lncRNA-ORF' ELSE 'other' END AS biotype, p_partkey % 4 IN (0, 3) AS ribosomal, p_partkey % 4 = 1 AND p_partkey % 5 IN (0, 4) AS control, count(*) AS n FROM t GROUP BY ALL".replace('["3\' UTR", "5\'UTR overlap"', "['3'' UTR', '5''UTR overlap'"))
def classified_sources(spark, d):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    gene = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("RPS", "MAGEB", "ABC", "MRPL")]), (F.col("p_partkey") % 4 + 1).cast("int")), (F.col("p_partkey") % 8).cast("string"))
    t = B.table(spark, d, "part").select(pick(_KINDS).alias("kind"), pick(_TISSUES).alias("tissue"), pick(_BIO).alias("bio"), gene.alias("gene"))
    return t.groupBy(K.class_of_atlas(F.col("kind")).alias("atlas"), K.tissue_tier(F.col("tissue")).alias("tier"), K.class_of_biotype(F.col("bio")).alias("biotype"), K.is_ribosomal(F.col("gene")).alias("ribosomal"), K.is_control(F.col("gene"), F.col("bio")).alias("control")).agg(F.count("*").alias("n"))


# ---- nulls by resampling ----------------------------------------------------------------------------------------


@query()
def placebo_null(spark, d):
    """200 reassignments of price bins; the observed difference beside their median and 97.5th percentile."""
    t = _price_bins(spark, d)
    draws = resample.placebo(t, t.select("bin"), 200, C.BOOTSTRAP_SEED, "p_size", "qty", "bin")
    seen = stats.last_minus_first(stats.standardized_mean(t, "qty", "p_size", "bin"), "bin", "mean").select(F.col("difference").alias("observed"))
    null = draws.crossJoin(F.broadcast(seen)).agg(F.count("*").alias("draws"), F.percentile("difference", 0.5).alias("median"), F.percentile("difference", 0.975).alias("high"), F.sum((F.col("difference") >= F.col("observed")).cast("long")).alias("beaten"))  # one row
    return seen.crossJoin(null)  # one row each


def swaps(refs: DataFrame, words: DataFrame, k: int, strong: int) -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
    """R8's two pools: (items, hits, family). An item is a word; its parent is the first of the parents that has it as a word, its hits
    all references that hold it. The family are references that are no one's parent and share a k-mer with the parent, or at
    `strong` places."""
    hits = sequence.matches(words.select("seq"), refs, ["item_id"], lengths=B.LENGTHS).select(F.col("seq").alias("item"), F.col("item_id").alias("gene")).distinct()
    items = words.select(F.col("seq").alias("item"), F.col("item_id").alias("parent"))
    parents = items.select(F.col("parent").alias("item_id")).distinct().join(refs, "item_id")
    family = store(kmers.family_counts(parents, refs.withColumnRenamed("item_id", "gene"), k, "item_id").withColumnRenamed("item_id", "parent"), "family")
    return {"any": (items, hits, family.select("parent", "gene")), "strong": (items, hits, family.where(F.col("places") >= strong).select("parent", "gene"))}


@query()
def decoy_swap_null(spark, d):
    """Words of references against random relatives of their reference, with both pools."""
    # every reference has a role: those of an even number of characters are parents, the others relatives
    bench = B.table(spark, d, "benchmark").where("length(text) % 2 = 0")
    words = bench.select("item_id", F.explode(F.split("text", "[ \n]+")).alias("w")).where(F.col("w").rlike("^[A-Za-z]{6,12}$")).groupBy(F.upper("w").alias("seq")).agg(F.min("item_id").alias("item_id"))
    out = None
    for pool, (items, hits, family) in swaps(B.references(spark, d), words, 6, 3).items():
        t = resample.decoy_swap(items, hits, family, C.PERMUTATIONS, 0).select(F.lit(pool).alias("pool"), "*")
        out = t if out is None else out.unionAll(t)
    return out


@query()
def null_rates(spark, d):
    """Share of sequences in the normal set, of shuffled ones (three times), of uniform ones, and of shuffled ones in the references."""
    q = B.occurrences(spark, d).select("seq").distinct()
    normal, weights = B.normal(spark, d), resample.letter_weights(q, "seq")
    rate = lambda t, name: t.agg(F.lit(name).alias("null"), F.avg(F.col("x").cast("double")).alias("rate"))
    among = lambda c: sequence.flagged(q.select(c.alias("seq")), normal, "seq", "x")
    three = [among(resample.shuffled(F.col("seq"), s)) for s in (1, 2, 3)]
    out = rate(among(F.col("seq")), "observed").unionAll(rate(three[0].unionAll(three[1]).unionAll(three[2]), "shuffled"))
    out = out.unionAll(rate(among(resample.uniform(F.col("seq"), 4, weights)), "uniform"))
    mixed = q.select(resample.shuffled(F.col("seq"), 5).alias("seq")).distinct()
    return out.unionAll(rate(sequence.flagged(mixed, sequence.contained(mixed, B.references(spark, d), lengths=B.LENGTHS), "seq", "x"), "shuffled in references"))


@query()
def exposure_permutation(spark, d):
    """Exposure labels shuffled within lengths; hits are exposed sequences that the references hold."""
    t = _exposed(spark, d).select(F.col("seq").alias("item"), F.col("len").alias("stratum"), F.col("x").alias("label"), F.col("hit").alias("target"))
    return resample.permutation_null(spark, t, C.PERMUTATIONS, 0)
