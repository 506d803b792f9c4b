"""Queries through files: the generated tables written in the formats that the readers know, read back, and summed up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import columns as K
from veristrata.operators import decoy, gates, phrases, registry
from veristrata.plans import base as B
from veristrata.plans.checkpoint import shared_dir, store
from veristrata.plans.ledger import class_decoy_ledger
from veristrata.plans.queries import _ALPHA, _Q, _ledger, _ledger_sql, query  # noqa: PLC2701
from veristrata.sources import claims as S
from veristrata.sources import readers as R
from veristrata.sources import sinks
from veristrata.sources import workbook as W
from veristrata.streaming.ledger import ledger_to_table, windowed_ledger


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, name: str) -> str:
    """Writes a column of lines as text files; their folder."""
    path = _path(df.sparkSession, name)
    df.write.text(path)
    return path


def _tsv(df: DataFrame, name: str, sep: str = "\t") -> str:
    """Writes a table with a header; the folder of its files."""
    path = _path(df.sparkSession, name)
    df.write.csv(path, header=True, sep=sep, escape='"', emptyValue="")
    return path


@query(f"WITH c AS ({B.CLAIMS_SQL}) SELECT orf_class, hla_allele, count(*) AS n, CAST(sum(length(CASE WHEN peptide_sequence = '' THEN 'not reported' ELSE peptide_sequence END)) AS BIGINT) AS letters, count(*) FILTER (WHERE accepted_decoys_in_class IS NULL) AS not_reported FROM (SELECT * REPLACE (trim(hla_allele) AS hla_allele) FROM c) GROUP BY 1, 2")
def catalogue_file(spark, d):
    """K1, S1, H1."""
    path = _path(spark, "catalogue")
    sinks.catalogue(B.claims(spark, d), path)
    t = R.claims_csv(spark, path)
    letters = F.length(F.coalesce(F.nullif("peptide_sequence", F.lit("")), F.lit("not reported")))
    return t.groupBy("orf_class", F.trim("hla_allele").alias("hla_allele")).agg(F.count("*").alias("n"), F.sum(letters).alias("letters"), F.sum((F.col("accepted_decoys_in_class") == "not reported").cast("long")).alias("not_reported"))


_ATLAS = f"WITH o AS ({B.OCCURRENCES_SQL})"


@query(_ATLAS + " SELECT tissue AS cancer_type, count(*) AS n, CAST(sum(CASE WHEN gene = 'src2' THEN 99 ELSE length(seq) END) AS BIGINT) AS residues, count(DISTINCT gene) AS genes FROM o GROUP BY 1")
def epitope_atlas_file(spark, d):
    """S2, S3."""
    length = F.when(F.col("gene") == "src2", "99.7").when(F.col("gene") == "src3", "unknown").otherwise(F.length("seq").cast("string"))
    path = _tsv(B.occurrences(spark, d).select(F.lower("seq").alias("Sequence"), length.alias("Length"), F.col("gene").alias("ORF_ID"), F.col("tissue").alias("Tissue")), "atlas")
    t = S.epitope_atlas(spark, path, "atlas", "10.1000/atlas", "Table 1")
    return t.groupBy("cancer_type").agg(F.count("*").alias("n"), F.sum(F.col("ligand_len").cast("long")).alias("residues"), F.count_distinct("orf_id_or_locus").alias("genes"))


@query(_ATLAS + " SELECT orf_class, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS residues FROM (SELECT seq, CASE tissue WHEN 'en' THEN 'uORF' WHEN 'fr' THEN 'altORF' ELSE 'other' END AS orf_class FROM o) GROUP BY 1")
def peptide_table_file(spark, d):
    """S4."""
    kind = F.when(F.col("tissue") == "en", "5' UTR").when(F.col("tissue") == "fr", "out of frame").otherwise("unknown")
    path = _tsv(B.occurrences(spark, d).select(F.col("gene").alias("gene.symbol"), F.col("seq").alias("Peptide"), F.lit("").alias("Peptide length"), kind.alias("type")), "peptides", ",")
    t = S.peptide_table(spark, path, "table", "10.1000/table", "Table 2")
    return t.groupBy("orf_class").agg(F.count("*").alias("n"), F.sum(F.col("ligand_len").cast("long")).alias("residues"))


@query(_ATLAS + " SELECT hla_allele, locus AS orf_id_or_locus, result AS tumor_specificity_result, cancer_type, orf_class, count(*) AS n, CAST(sum(len) AS BIGINT) AS residues FROM (SELECT CASE WHEN tissue = 'en' THEN 'A, B' WHEN tissue = 'fr' THEN 'say \"C\"' ELSE 'D' END AS hla_allele, gene AS locus, tissue AS cancer_type, 'lncRNA-ORF' AS orf_class, CASE WHEN gene = 'src3' THEN length(seq) + 1 ELSE length(seq) END AS len, CASE WHEN tissue = 'de' THEN 'absent-from-normal' ELSE 'detected-in-normal' END AS result FROM o) GROUP BY ALL")
def epitope_table_file(spark, d):
    """Claims of fields by place, some quoted with the separator or quotes in them, under a header that is out of step."""
    allele = F.when(F.col("tissue") == "en", "A, B").when(F.col("tissue") == "fr", 'say "C"').otherwise("D")
    low = F.when(F.col("tissue") == "de", " Yes").otherwise("no")
    length = F.length("seq") + F.when(F.col("gene") == "src3", 1).otherwise(0)
    size = F.when(F.col("gene") == "src2", "unknown").otherwise(F.concat(length.cast("string"), F.lit(".0")))
    fields = {0: F.lower("seq"), 1: F.col("tissue"), 2: allele, 6: size, 8: F.col("gene"), 10: low, 16: F.lit("lincRNA")}
    path = _tsv(B.occurrences(spark, d).select(*[fields.get(i, F.lit("x")).alias(f"misplaced{i}") for i in range(17)]), "epitopes", ",")
    t = S.epitope_table(spark, path, "table", "10.1000/epitopes", "Table 3")
    return t.groupBy("hla_allele", "orf_id_or_locus", "tumor_specificity_result", "cancer_type", "orf_class").agg(F.count("*").alias("n"), F.sum(F.col("ligand_len").cast("long")).alias("residues"))


@query("WITH t AS (SELECT doc_id, source, lang, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents) SELECT upper(source) AS gene, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS residues, min('P' || doc_id) AS first, count(DISTINCT seq) AS sequences FROM t WHERE seq <> '' AND lang = 'en' GROUP BY 1")
def fasta_file(spark, d):
    """Headers with attributes, sequences over several lines, one species."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    head = F.concat(F.lit(">sp|P"), F.col("doc_id").cast("string"), F.lit("|E"), F.col("doc_id").cast("string"), F.lit("_X A protein OX="), F.when(F.col("lang") == "en", "9606").otherwise("10090"), F.lit(" GN="), F.col("source"), F.lit(" PE=1"))
    record = F.concat(head, F.lit("\n"), F.regexp_replace(letters, "(.{60})", "$1\n"))
    path = _lines(B.table(spark, d, "documents").where("text is not null and lang is not null").select(record.alias("value")), "fasta")
    t = R.fasta(spark, path, "9606")
    genes = t.select(F.upper("gene").alias("gene"), "acc", "seq")
    different = S.gene_sequences(t).groupBy("gene").agg(F.count("*").alias("sequences"))
    return genes.groupBy("gene").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("residues"), F.min("acc").alias("first")).join(different, "gene")


@query("WITH t AS (SELECT source, lang, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents) SELECT source AS gene, lang, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS residues FROM t WHERE seq <> '' AND source IS NOT NULL AND lang IN ('en', 'de') GROUP BY ALL")
def gzip_fasta_file(spark, d):
    """Compressed sequences of two species, each read by its number in the headers."""
    t = B.table(spark, d, "documents").where("text is not null and source is not null and lang is not null")
    species = F.when(F.col("lang") == "en", "9606").when(F.col("lang") == "de", "960").otherwise("10090")
    head = F.concat(F.lit(">sp|X|Y_Z A protein OX="), species, F.lit(" GN="), F.col("source"))
    path = _path(spark, "fasta-gz")
    t.select(F.concat(head, F.lit("\n"), F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]", ""), "(.{60})", "$1\n")).alias("value")).write.text(path, compression="gzip")
    own = lambda ox, lang: R.fasta(spark, path + "/*.gz", ox).select("gene", F.lit(lang).alias("lang"), "seq")
    return own("9606", "en").unionAll(own("960", "de")).groupBy("gene", "lang").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("residues"))


@query("SELECT 'ENSG' || label AS gene, vec_id AS row, CAST(embedding[1] AS DOUBLE) AS first, CAST(list_max(embedding) AS DOUBLE) AS most FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM embeddings) WHERE k = 1")
def expression_by_id_file(spark, d):
    """Of rows of one gene id (its versions differ) the last in the order of the files stays."""
    v = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), "\t")
    row = F.concat(F.lit("ENSG"), F.col("label").cast("string"), F.lit("."), F.col("vec_id").cast("string"), F.lit("\t"), F.col("vec_id").cast("string"), F.lit("\t"), F.col("vec_id").cast("string"), F.lit("\t"), v)
    t = B.table(spark, d, "embeddings").repartitionByRange(5, "vec_id").sortWithinPartitions("vec_id")
    got = R.expression_gct(spark, _lines(t.select(row.alias("value")), "expression"), by_ensembl=True)
    values = F.slice("vector", 2, 1_000_000)
    return got.select("gene", F.get("vector", F.lit(0)).cast("long").alias("row"), F.get(values, F.lit(0)).alias("first"), F.array_max(values).alias("most"))


@query("WITH l AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings) SELECT 'S' || label AS gene, CAST(i AS INT) AS i, CAST(max(embedding[i]) AS DOUBLE) AS v FROM l GROUP BY 1, 2")
def expression_file(spark, d):
    """Symbols repeat; the greatest value of each tissue stays."""
    v = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), "\t")
    row = F.concat(F.lit("ENSG"), F.col("vec_id").cast("string"), F.lit(".1\tS"), F.col("label").cast("string"), F.lit("\t"), v)
    path = _lines(B.table(spark, d, "embeddings").select(F.explode(F.array(row, F.lit("Name\tDescription\tskip"))).alias("value")), "expression")
    return R.expression_gct(spark, path).select("gene", F.posexplode("vector").alias("i", "v")).select("gene", (F.col("i") + 1).alias("i"), "v")


_PSM_COLUMNS = "CAST(event_id AS STRING) AS PSMId, 'P' || CAST(user_id AS STRING) AS peptide, CASE WHEN event_type = 'error' THEN 'rev_' ELSE '' END || CASE user_id % 3 WHEN 0 THEN 'sp|' WHEN 1 THEN 'orf' ELSE 'ENSP' END || CAST(user_id AS STRING) AS Proteins, CAST(value AS STRING) AS score"


def _psm_file(spark, d) -> DataFrame:
    return R.psm_tsv(spark, _tsv(B.table(spark, d, "events").selectExpr(*_PSM_COLUMNS.split(", ")), "psms"), decoy=None, score="score")


@query(_ledger_sql(f"SELECT * FROM q WHERE q <= {_ALPHA}"))
def psm_file_ledger(spark, d):
    """A table of matches to its ledger, and the ledger's files read back."""
    t = _psm_file(spark, d).drop("q").withColumn("event_id", F.col("id").cast("long"))
    ledger = _ledger(decoy.accepted(decoy.q_sweep(t, "score", "is_decoy", "event_id"), _ALPHA))
    path = _path(spark, "ledger")
    sinks.ledger_files(ledger, {"analysis_id": "events", "software": "PSM-table", "unit": "psm", "alpha": _ALPHA, "fdr_convention": "(D+1)/T"}, path)
    whole = R.json_artifact(spark, path + ".json").select(F.explode("ledger").alias("r")).select("r.*")
    return whole.select("class", "n_target", "n_decoy", "all_target", "all_decoy").join(ledger.select("class", "class_fdr", "share"), "class").select(*ledger.columns)


@query(f"SELECT class, n_target, n_decoy, n FROM ({_ledger_sql(f'SELECT * FROM q WHERE q <= {_ALPHA}')}) JOIN (WITH {_Q} SELECT class, count(*) AS n FROM q WHERE q IS NOT NULL GROUP BY 1) USING (class)")
def ledger_command(spark, d):
    """The ledger command on a table of matches, with strata and the contract: its JSON, and the matches of its folders by class."""
    path, out = _tsv(B.table(spark, d, "events").selectExpr(*_PSM_COLUMNS.split(", ")), "psms"), _path(spark, "command")
    class_decoy_ledger(spark, path, out, score="score", alpha=_ALPHA, strata=True, emit_contract=True)
    said = R.json_artifact(spark, out + ".json").select(F.explode("ledger").alias("r")).select("r.class", "r.n_target", "r.n_decoy")
    per = spark.read.option("sep", "\t").csv(out + ".by-class", header=True).groupBy("class").agg(F.count("*").alias("n"))
    return said.join(per, "class")


@query("SELECT CASE user_id % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'noncanonical' ELSE 'variant' END AS class, event_type = 'error' AS is_decoy, count(*) AS n, round(sum(value), 4) AS score FROM events WHERE value IS NOT NULL GROUP BY ALL")
def pepxml_file(spark, d):
    """Hits of rank 1 with a score; others of the same spectrum are left out."""
    hit = lambda rank: F.concat(F.lit(f'<search_hit hit_rank="{rank}" peptide="P'), F.col("user_id").cast("string"), F.lit('" protein="'), F.when(F.col("event_type") == "error", "rev_").otherwise(""), F.element_at(F.array(F.lit("sp|"), F.lit("orf"), F.lit("ENSP")), (F.col("user_id") % 3 + 1).cast("int")), F.col("user_id").cast("string"), F.lit('"><search_score name="hyperscore" value="'), F.col("value").cast("string"), F.lit('"/></search_hit>'))
    line = F.concat(F.lit('<spectrum_query index="'), F.col("event_id").cast("string"), F.lit('"><search_result>'), hit(1), hit(2), F.lit("</search_result></spectrum_query>"))
    events = B.table(spark, d, "events").where("value is not null")
    files = max(16, events.count() // 500_000)
    t = events.select(F.pmod("event_id", F.lit(files)).alias("g"), "event_id", line.alias("value"))
    ends = spark.range(files).select("id", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit("<msms_run_summary>").alias("v")), F.struct(F.lit(1 << 62).alias("at"), F.lit("</msms_run_summary>").alias("v")))).alias("x"))
    path = _path(spark, "pepxml")  # files that follow the rows, each with its root element
    t.unionAll(ends.select("id", "x.at", "x.v")).repartition(files, "g").sortWithinPartitions("g", "event_id").select("g", "value").write.partitionBy("g").text(path)
    t = R.pepxml(spark, path)
    return t.groupBy("class", "is_decoy").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("WITH t AS (SELECT 'ENSP' || s_suppkey AS protein, max(s_acctbal) AS ppm FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT protein, ppm, 'E' || substr(protein, 5) AS entry FROM t")
def abundance_file(spark, d):
    """Abundances joined to entry names by the links of one taxon."""
    t = B.table(spark, d, "supplier")
    ident, bal = F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string")
    rows = F.array(F.lit("# a comment"), F.concat(F.lit("9606.x\tENSP"), ident, F.lit("\t"), bal), F.concat(F.lit("9606.y\tENSP"), ident, F.lit("\t-1")), F.lit("no number\tENSP0\tx"))
    a = R.abundance(spark, _lines(t.select(F.explode(rows).alias("value")), "abundance"))
    link = F.array(F.concat(F.lit("9606.ENSP"), ident, F.lit("\tE"), ident), F.concat(F.lit("10090.ENSP"), ident, F.lit("\tMOUSE")))
    links = R.id_links(spark, _lines(t.select(F.explode(link).alias("value")), "links"))
    return a.join(links.select(F.substring_index("protein", ".", -1).alias("protein"), "entry"), "protein")


@query("SELECT upper(n_name) AS seq, CAST(count(*) AS INT) AS tissues FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def normal_ligand_file(spark, d):
    """Ligands of one class with their tissues."""
    t = B.table(spark, d, "nation").join(B.table(spark, d, "customer"), F.expr("c_nationkey = n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.count("*").cast("int").alias("n"))
    tissues = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("tissue"), i.cast("string"))), ", ")
    row = t.select(F.explode(F.array(F.lit("HLA-I"), F.lit("HLA-II only"))).alias("kind"), "n_nationkey", "n_name", tissues.alias("tissues")).where("kind = 'HLA-I'")
    path = _tsv(row.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("ligand"), F.col("kind").alias("mhc"), F.lit("").alias("x"), "tissues"), "ligands")
    return R.normal_ligands(spark, path).select("seq", F.size("tissues").alias("tissues"))


@query("WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT 'symbol' AS kind, count(*) AS n, count(DISTINCT s_suppkey) AS genes FROM s UNION ALL SELECT 'synonym', 2 * count(*), count(DISTINCT s_suppkey) FROM s WHERE s_nationkey < 12 UNION ALL SELECT 'xref', count(*), count(DISTINCT s_suppkey) FROM s")
def gene_info_file(spark, d):
    """S17."""
    k = F.col("s_suppkey").cast("string")
    names = F.when(F.col("s_nationkey") < 12, F.concat(F.lit("A"), k, F.lit("|B"), k)).otherwise("-")
    t = B.table(spark, d, "supplier").select(F.lit("9606").alias("tax"), k.alias("id"), F.concat(F.lit("G"), k).alias("symbol"), F.lit("-").alias("locus"), names.alias("synonyms"), F.concat(F.lit("MIM:1|Ensembl:ENSG"), k, F.lit(".2|HGNC:3")).alias("xrefs"))
    return R.gene_info(spark, _tsv(t, "gene_info")).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("gene_id").alias("genes"))


@query("SELECT CAST(s_nationkey AS STRING) AS a, CAST(s_suppkey AS STRING) AS b FROM supplier GROUP BY ALL")
def gene_group_file(spark, d):
    """A relation stated from either side."""
    side = F.col("s_suppkey") % 2 == 0
    own = [F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")]
    t = B.table(spark, d, "supplier").select(F.lit("9606").alias("tax"), F.when(side, own[0]).otherwise(own[1]).alias("GeneID"), F.when(side, "Related functional gene").otherwise("Related pseudogene").alias("relationship"), F.lit("9606").alias("tax2"), F.when(side, own[1]).otherwise(own[0]).alias("other"))
    odd = t.withColumn("relationship", F.lit("Region parent"))
    return R.gene_group(spark, _tsv(t.unionAll(odd), "gene_group"))


@query("SELECT name, CAST(gene_id AS STRING) AS gene_id, CAST(kind AS INT) AS kind FROM (SELECT name, gene_id, kind, row_number() OVER (PARTITION BY name ORDER BY kind, CAST(gene_id AS STRING)) AS k FROM (SELECT 'G' || s_suppkey AS name, s_suppkey AS gene_id, 0 AS kind FROM supplier UNION ALL SELECT 'G' || (s_suppkey + 1), s_suppkey, 1 FROM supplier UNION ALL SELECT 'N' || s_nationkey, s_suppkey, 2 FROM supplier)) WHERE k = 1")
def symbol_file(spark, d):
    """Current symbols before previous ones before aliases."""
    k = F.col("s_suppkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    t = B.table(spark, d, "supplier").select(k.cast("string").alias("entrez_id"), name("G", k).alias("symbol"), name("G", k + 1).alias("prev_symbol"), name("N", F.col("s_nationkey")).alias("alias_symbol"), F.lit("").alias("gene_group"))
    return R.hgnc(spark, _tsv(t, "hgnc"))


_KEYS = "SELECT c_custkey, list_extract(['g' || n, ' H' || n, 'P' || n, 'S' || c_nationkey, 'T' || n, 'C' || n, ' '], c_custkey % 7 + 1) AS symbol, n FROM (SELECT *, c_custkey // 7 % (SELECT count(*) + 5 FROM supplier) AS n FROM customer)"


@query(
    f"WITH k AS ({_KEYS}), s AS (SELECT s_suppkey AS id, s_nationkey AS nation, s_acctbal > 0 AS linked FROM supplier), u AS (SELECT nation, min(id) AS id FROM s GROUP BY 1 HAVING count(*) = 1)"
    " SELECT c_custkey, symbol, CAST(CASE c_custkey % 7 WHEN 0 THEN s.id WHEN 1 THEN s.id WHEN 2 THEN s.id WHEN 3 THEN u.id WHEN 4 THEN s.id WHEN 5 THEN CASE WHEN s.linked THEN s.id END END AS VARCHAR) AS id,"
    " CASE WHEN c_custkey % 7 = 0 AND s.id IS NOT NULL THEN 'symbol' WHEN c_custkey % 7 IN (1, 2) AND s.id IS NOT NULL THEN 'registry' WHEN c_custkey % 7 = 3 AND u.id IS NOT NULL OR c_custkey % 7 = 4 AND s.id IS NOT NULL THEN 'synonym' WHEN c_custkey % 7 = 5 AND s.linked THEN 'annotation' END AS route"
    " FROM k LEFT JOIN s ON s.id = k.n LEFT JOIN u ON c_custkey % 7 = 3 AND 'S' || u.nation = k.symbol"
)
def symbol_cascade_files(spark, d):
    """J14 through files of four registries: symbols, another registry's symbols and former ones, synonyms of one gene only, clone names."""
    t = B.table(spark, d, "supplier")
    k, id_ = F.col("s_suppkey").cast("string"), F.col("s_suppkey").cast("string").alias("id")
    name = lambda p, c=k: F.concat(F.lit(p), c)
    synonyms = F.concat(name("s", F.col("s_nationkey").cast("string")), F.lit("|"), name("T"))
    xrefs = F.when(F.col("s_acctbal") > 0, F.concat(name("MIM:1|Ensembl:ENSG"), F.lit(".2"))).otherwise("-")
    info = R.gene_info(spark, _tsv(t.select(F.lit("9606").alias("tax"), id_, name("G").alias("symbol"), F.lit("-").alias("locus"), synonyms.alias("synonyms"), xrefs.alias("xrefs")), "gene_info"))
    hgnc = R.hgnc(spark, _tsv(t.select(k.alias("entrez_id"), name("H").alias("symbol"), name("P").alias("prev_symbol"), F.lit("").alias("alias_symbol"), F.lit("").alias("gene_group")), "hgnc"))
    gtf = F.concat(F.lit('chr1\tX\tgene\t1\t2\t.\t+\t.\tgene_id "ENSG'), k, F.lit('.7"; gene_name "C'), k, F.lit('";'))
    names = R.gene_names(spark, _lines(t.select(gtf.alias("value")), "gtf"))
    many = t.count() + 5
    n = ((F.col("c_custkey") - F.col("c_custkey") % 7) / 7).cast("long") % many
    kinds = [name(p, n.cast("string")) for p in ("g", " H", "P")] + [name("S", F.col("c_nationkey").cast("string"))] + [name(p, n.cast("string")) for p in ("T", "C")] + [F.lit(" ")]
    keys = B.table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*kinds), (F.col("c_custkey") % 7 + 1).cast("int")).alias("symbol"))
    return registry.symbol_to_gene(keys, "symbol", info, hgnc, names)


@query("SELECT 'G' || s_nationkey AS name, 'ENSG' || min(s_suppkey) AS first, 'ENSG' || max(s_suppkey) AS last FROM supplier GROUP BY s_nationkey")
def annotation_file(spark, d):
    """Names of genes, the first row's id and the last one's, in the order of the files' paths and of their lines."""
    k, gene = F.col("s_suppkey").cast("string"), F.concat(F.lit("G"), F.col("s_nationkey").cast("string"))
    line = lambda kind: F.concat(F.lit(f"chr1\tX\t{kind}\t1\t2\t.\t+\t.\tgene_id \"ENSG"), k, F.lit('.7"; transcript_id "ENST'), k, F.lit('.1"; gene_name "'), gene, F.lit('";'))
    t = B.table(spark, d, "supplier").repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey")  # files in order, each a range
    path = _lines(t.select(F.explode(F.array(F.lit("#!comment"), line("gene"), line("transcript"))).alias("value")), "gtf")
    first = R.transcript_genes(spark, path)[1].select(F.col("gene_name").alias("name"), F.col("gene_id").alias("first"))
    return first.join(R.gene_names(spark, path).select(F.col("gene_name").alias("name"), F.col("gene_id").alias("last")), "name")


@query("SELECT page_id, octet_length(encode(html)) AS length, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL AND html <> ''")
def page_digests(spark, d):
    """Pages through files: the digest of each as it comes back. The files' own digests are of their bytes, or this is an error."""
    path = _path(spark, "pages")
    t = B.table(spark, d, "pages").where("html is not null and html <> ''").select(F.base64(F.encode("html", "UTF-8")).alias("h"), "page_id")
    sinks.sorted_table(t.select("page_id", F.regexp_replace("h", "\\s", "").alias("h")), path, "page_id")
    whole = spark.read.format("binaryFile").load(path + "/*.csv").select(F.col("path"), F.sha2("content", 256).alias("own"))
    gates.same(R.digests(spark, path + "/*.csv").select("path", F.col("sha256").alias("own")), whole, "path", "own")
    raw = F.unbase64("h")
    return R.headered_csv(spark, path).select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(raw).alias("length"), F.sha2(raw, 256).alias("sha256"))


@query("SELECT item_id, length(t) AS letters, contains(t, '& ') AS marked, len(regexp_extract_all(t, '[0-9]+')) AS numbers FROM (SELECT item_id, trim(regexp_replace('R & D < ' || text, '\\s+', ' ', 'g')) AS t FROM benchmark WHERE text IS NOT NULL)")
def article_files(spark, d):
    """An XML file an article, read whole: tags out, entities unescaped, white space collapsed; its numbers."""
    path = _path(spark, "articles")
    escaped = F.concat(F.lit("<article id=\"1\"><p>R &amp; D &lt;</p>\n<p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></article>"))
    B.table(spark, d, "benchmark").where("text is not null").select("item_id", escaped.alias("value")).write.partitionBy("item_id").text(path)
    t = R.whole_texts(spark, path).select(F.regexp_extract("path", r"item_id=(-?\d+)", 1).cast("long").alias("item_id"), K.plain_text(F.col("value")).alias("t"))
    numbers = phrases.find_pattern(t, "[0-9]+", "t", ["item_id"]).groupBy("item_id").agg(F.count("*").alias("numbers"))
    one = t.select("item_id", F.length("t").cast("long").alias("letters"), F.col("t").contains("& ").alias("marked"))
    return one.join(numbers, "item_id", "left").withColumn("numbers", F.coalesce("numbers", F.lit(0)))


@query("WITH p AS (SELECT CASE user_id % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'novel' ELSE 'other' END AS class, user_id FROM events) SELECT class, count(*) AS n FROM p GROUP BY 1")
def class_rules_file(spark, d):
    """Classes by the rules of a file, one folder a class, and the manifest."""
    rules = R.class_rules(spark, _lines(spark.createDataFrame([("# pattern\tclass",), ("^sp[|]\tcanonical",), ("^orf[0-9]+$\tnovel",)], "value string").coalesce(1), "rules"))
    acc = F.concat(F.element_at(F.array(F.lit("sp|"), F.lit("orf"), F.lit("ENSP")), (F.col("user_id") % 3 + 1).cast("int")), F.col("user_id").cast("string"))
    t = B.table(spark, d, "events").select(K.class_of_accession(acc, rules).alias("class"), "event_id")
    return sinks.by_class(t, _path(spark, "by-class")).withColumnRenamed("rows", "n")


@query("SELECT 'c' || conv_id AS sheet_row, CAST(count(*) AS INT) AS cells FROM conversations GROUP BY 1")
def sheet_rows(spark, d):
    """The header of an exported sheet found by what it must say; rows before it are none of the table."""
    own = B.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    body = own.select((F.col("conv_id") + 10).alias("_row_idx"), F.array(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("n").cast("string")).alias("cells"))
    head = spark.createDataFrame([(0, ["A title", None]), (1, ["Peptide id", "Cells (n)"])], "_row_idx long, cells array<string>")
    t = R.sheet(head.unionAll(body), ["peptide", "cells"])
    place = F.array_position(F.transform("header", lambda h: F.lower(h).contains("cells")), F.lit(True)).cast("int")
    return t.select(F.get("cells", F.lit(0)).alias("sheet_row"), F.element_at("cells", place).cast("int").alias("cells"))


_KIND = "CASE {t} WHEN 'en' THEN 'lincRNA' WHEN 'fr' THEN 'protein_coding' WHEN 'de' THEN 'processed_pseudogene' ELSE 'TEC' END"
_BOOKS = f"WITH o AS (SELECT DISTINCT seq, tissue, gene FROM ({B.OCCURRENCES_SQL}) WHERE gene IS NOT NULL), n AS (SELECT DISTINCT gene, seq FROM o WHERE length(seq) >= 11), m AS (SELECT gene, seq, max(tissue) AS tissue FROM o GROUP BY ALL), k AS (SELECT gene, seq, 'Table S3 + Fig 6' AS citation_location, 'type ' || length(seq) AS hla_allele, tissue FROM n JOIN m USING (gene, seq) UNION ALL SELECT gene, 'X' || seq, 'Table S3 + Fig 6', 'type ' || length(seq), NULL FROM n UNION ALL SELECT gene, seq, 'Table S2', 'not reported', tissue FROM o WHERE (gene, seq) NOT IN (SELECT (gene, seq) FROM n))"


def _book(rows: DataFrame, sheet: str, at: int, head: list[list[str | None]], cells: list) -> DataFrame:
    """Rows of one sheet of a workbook a gene, its head first; what they are sorted by."""
    spark = rows.sparkSession
    top = spark.createDataFrame([(i - 100, h) for i, h in enumerate(head)], "k int, cells array<string>")
    every = rows.select("workbook").distinct().join(top.withColumn("_on", F.lit(1)), F.col("_on") == 1).select("workbook", F.col("k"), F.lit("").alias("seq"), F.lit("").alias("tissue"), "cells")
    own = rows.select("workbook", F.lit(0).alias("k"), "seq", F.coalesce("tissue", F.lit("")).alias("tissue"), F.array(*cells).alias("cells"))
    return every.unionAll(own).withColumn("sheet", F.lit(sheet)).withColumn("at", F.lit(at))


@query(_BOOKS + f", c AS (SELECT *, {_KIND.format(t='tissue')} AS kind FROM k) SELECT gene, citation_location, CASE WHEN tissue IS NULL THEN 'other' WHEN kind = 'lincRNA' THEN 'lncRNA-ORF' WHEN kind = 'protein_coding' THEN 'altORF' WHEN kind = 'processed_pseudogene' THEN 'pseudogene-ORF' ELSE 'other' END AS orf_class, hla_allele, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS letters FROM c GROUP BY ALL")
def candidate_workbooks(spark, d):
    """A workbook a gene, of all its words and of long ones (and some that no other sheet has), whose header is to be found."""
    t = B.occurrences(spark, d).where("gene is not null").distinct().withColumn("workbook", F.col("gene"))
    kind = F.expr(_KIND.format(t="tissue"))
    found = _book(t, "Supplementary Table S2", 0, [["Gene Symbol", "Peptide", "Biotype", "Gen_Location"]], [F.col("gene"), F.lower("seq"), kind, F.when(F.col("tissue") == "fr", "genebody")])
    long = t.where(F.length("seq") >= 11).select("workbook", "gene", "seq").distinct().withColumn("tissue", F.lit(None).cast("string"))
    both = long.select("*", F.length("seq").alias("n")).withColumn("seq", F.explode(F.array(F.col("seq"), F.concat(F.lit("X"), "seq"))))
    hla = F.concat(F.lit("type "), F.col("n").cast("string"))
    tested = _book(both, "Supplementary Table S3", 1, [["Candidates"], None, ["No.", "Peptide sequence", "Gene symbol (HGNC)", "Predicted HLA"]], [F.lit("1"), F.col("seq"), F.col("gene"), hla])
    path = _path(spark, "workbooks")
    W.write_workbooks(found.unionAll(tested), path, ["at", "k", "seq", "tissue"])
    rows = store(W.read_workbooks(spark, path), "sheets")  # each sheet is parsed once
    claims = W.candidate_workbook_claims(rows, "10.1000/book", "x", "cohort:books")
    claims = claims.withColumn("gene", F.regexp_extract("path", r"([^/]*)[.]xlsx$", 1))
    return claims.groupBy("gene", "citation_location", "orf_class", "hla_allele").agg(F.count("*").alias("n"), F.sum(F.length("peptide_sequence")).alias("letters"))


#: A workbook a source: its texts are gene rows with the long words of the text as peptides, the words of 12 letters are tested, and
#: words with a q-value are those of 9 letters in any text, twice, with an annotation.
_GENES = f"""WITH o AS (SELECT DISTINCT seq, gene, tissue FROM ({B.OCCURRENCES_SQL}) WHERE gene IS NOT NULL),
  g AS (SELECT source AS book, doc_id, CASE WHEN doc_id % 11 = 0 THEN 'SAGE1' ELSE 'G' || doc_id END AS gene, {_KIND.format(t='lang')} AS kind, list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda x: regexp_full_match(x, '[A-Za-z]{{11,12}}')), lambda x: upper(x))) AS peps FROM documents WHERE source IS NOT NULL),
  p AS (SELECT book, gene, kind, unnest(CASE WHEN len(peps) > 0 THEN peps ELSE ['not reported'] END) AS pep, len(peps) > 0 AS has FROM g),
  q AS (SELECT DISTINCT gene AS book, seq, CAST(length(seq) + 100 AS DOUBLE) / 10000 AS q FROM o WHERE length(seq) IN (9, 12)),
  t AS (SELECT gene AS book, seq, max(tissue) AS tissue FROM o WHERE length(seq) = 12 GROUP BY ALL),
  c AS (SELECT book, 'Table S23' AS place, CASE WHEN kind = 'lincRNA' THEN 'lncRNA-ORF' WHEN kind = 'processed_pseudogene' THEN 'pseudogene-ORF' ELSE 'other' END AS orf_class, CASE WHEN gene = 'SAGE1' AND kind NOT IN ('lincRNA', 'processed_pseudogene') THEN 'TAA' ELSE 'TSA' END AS antigen_type, 'not reported' AS result, pep, q.q FROM p LEFT JOIN q USING (book) WHERE q.seq = p.pep
    UNION ALL SELECT book, 'Table S23', CASE WHEN kind = 'lincRNA' THEN 'lncRNA-ORF' WHEN kind = 'processed_pseudogene' THEN 'pseudogene-ORF' ELSE 'other' END, CASE WHEN gene = 'SAGE1' AND kind NOT IN ('lincRNA', 'processed_pseudogene') THEN 'TAA' ELSE 'TSA' END, 'not reported', pep, NULL FROM p WHERE (book, pep) NOT IN (SELECT (book, seq) FROM q)
    UNION ALL SELECT book, 'Tables S16/S17/S18', CASE {_KIND.format(t='tissue')} WHEN 'lincRNA' THEN 'lncRNA-ORF' WHEN 'processed_pseudogene' THEN 'pseudogene-ORF' ELSE 'other' END, 'TSA', CASE tissue WHEN 'en' THEN 'absent-from-normal' WHEN 'fr' THEN 'detected-in-normal' ELSE 'not reported' END, t.seq, q.q FROM t JOIN q USING (book, seq))"""


def _gene_books(spark, d) -> DataFrame:
    """The parsed rows of the workbooks that _GENES describes."""
    kind = lambda c: F.expr(_KIND.format(t=c))
    words = F.array_distinct(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]+"), lambda x: x.rlike("^[A-Za-z]{11,12}$")), lambda x: F.lower(x)))
    t = B.table(spark, d, "documents").where("source is not null").select(F.col("source").alias("workbook"), F.col("doc_id").cast("string").alias("seq"), F.col("lang").alias("tissue"), "doc_id", words.alias("words"))
    gene = F.when(F.col("doc_id") % 11 == 0, "SAGE1").otherwise(F.concat(F.lit("G"), F.col("doc_id").cast("string")))
    x = F.lit("x")
    sheets = [_book(t, "S23", 0, [["gene_id", "transcript_id", "gene_name", "gene_type", "n", "%", "Source", "Peptide", "high"]], [F.concat(F.lit("E"), "seq"), x, gene, kind("tissue"), F.lit("2"), x, x, F.array_join("words", "; "), x])]
    o = B.occurrences(spark, d).where("gene is not null").select(F.col("gene").alias("workbook"), "seq", "tissue").distinct()
    q = ((F.length("seq") + 100).cast("double") / 10000).cast("string")
    named = F.concat(F.substr("seq", F.lit(1), F.lit(4)), F.lit("(Oxidation)"), F.substr("seq", F.lit(5), F.lit(99)))
    some = o.where(F.length("seq").isin(9, 12))
    both = some.select("workbook", "seq", "tissue", F.explode(F.array(F.struct(named.alias("as"), q.alias("q")), F.struct(F.lower("seq").alias("as"), F.lit("0.9").alias("q")))).alias("m"))
    sheets.append(_book(both, "S26", 1, [["target_decoy", "sequence", "q-value"]], [F.lit("target"), F.col("m.as"), F.col("m.q")]))
    tested = o.where(F.length("seq") == 12).groupBy("workbook", "seq").agg(F.max("tissue").alias("tissue"))
    sheets.append(_book(tested, "S19", 2, [["a", "b", "gene_name", "gene_type"]], [x, x, F.concat(F.lit("N"), "seq"), kind("tissue")]))
    said = F.when(F.col("tissue") == "en", "Yes").when(F.col("tissue") == "fr", " no").otherwise("?")
    sheets.append(_book(tested, "S16", 3, [["h"] * 12], [F.lower("seq"), x, F.concat(F.lit("N"), "seq"), *[x] * 6, said, x, F.lit("YES")]))
    every = sheets[0]
    for more in sheets[1:]:
        every = every.unionAll(more)
    path = _path(spark, "gene-books")
    W.write_workbooks(every, path, ["at", "k", "seq", "tissue"])
    return store(W.read_workbooks(spark, path), "sheets").withColumn("path", F.regexp_extract("path", r"([^/]*)[.]xlsx$", 1))


@query(_GENES + " SELECT book, place AS citation_location, orf_class, antigen_type, result AS tumor_specificity_result, count(*) AS n, count(q) AS with_q, round(sum(q), 6) AS q, CAST(sum(length(pep)) AS BIGINT) AS letters FROM c GROUP BY ALL")
def gene_workbooks(spark, d):
    """Claims of workbooks of genes with their peptides, tested peptides, types and q-values."""
    claims = W.gene_workbook_claims(_gene_books(spark, d), W.REACTIVE, W.NEGATIVE, "10.1000/genes", "x", "cohort:genes")
    q = F.col("psm_qvalue").try_cast("double")
    return claims.groupBy(F.col("path").alias("book"), "citation_location", "orf_class", "antigen_type", "tumor_specificity_result").agg(F.count("*").alias("n"), F.count(q).alias("with_q"), F.round(F.sum(q), 6).alias("q"), F.sum(F.length("peptide_sequence")).alias("letters"))


@query(_GENES + " SELECT book, count(*) AS n, min(seq) AS first FROM q WHERE (book, seq) NOT IN (SELECT (book, pep) FROM c) GROUP BY 1")
def unattached_workbook_keys(spark, d):
    """Peptides with a q-value that no claim of their workbook carries."""
    rows = _gene_books(spark, d)
    claims = W.gene_workbook_claims(rows, W.REACTIVE, W.NEGATIVE, "10.1000/genes", "x", "cohort:genes")
    return W.unattached_q_values(rows, claims).groupBy(F.col("path").alias("book")).agg(F.count("*").alias("n"), F.min("peptide").alias("first"))


@query("WITH e AS (SELECT *, event_type AS class FROM events WHERE value IS NOT NULL) SELECT class, date_trunc('day', ts) AS start, count(*) FILTER (WHERE value < 50) AS n_decoy, count(*) FILTER (WHERE value >= 50) AS n_target FROM e GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM e)")
def stream_ledger(spark, d):
    """The windowed ledger of a stream of matches, as far as its watermark has closed windows."""
    stream = spark.readStream.schema(B.table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern may be a file or a folder
    t = stream.where("value is not null").select(F.col("event_type").alias("class"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") < 50).alias("is_decoy"))
    path = _path(spark, "stream")
    ledger_to_table(windowed_ledger(t), path, path + "-progress").awaitTermination()
    return spark.read.schema("start timestamp, class string, n_target long, n_decoy long").parquet(path)
