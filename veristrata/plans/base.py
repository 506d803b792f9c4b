"""The generated tables in the roles of the audit: claims, sequence occurrences, references, spectrum matches. As DataFrames, and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A claim a document; its sequence is the alphabetically last word of seven letters or more in the whole text.
CLAIMS = """
SELECT d.doc_id AS claim_id, upper(coalesce({last_word}, '')) AS peptide_sequence, d.source || '_' || CAST(d.n_chars AS STRING) || 'aa' AS orf_id_or_locus,
  CASE d.lang WHEN 'en' THEN 'lncRNA-ORF' WHEN 'fr' THEN 'uORF' WHEN 'de' THEN 'altORF' WHEN 'es' THEN 'pseudogene-ORF' ELSE 'odd class' END AS orf_class,
  CASE WHEN d.n_chars % 2 = 0 THEN 'TSA' ELSE 'TAA' END AS antigen_type, d.lang AS cancer_type,
  CASE WHEN d.n_chars % 5 = 0 THEN 'HLA-A*02:01' WHEN d.n_chars % 5 = 1 THEN ' NA ' ELSE 'not reported' END AS hla_allele,
  CASE WHEN d.n_chars % 4 = 0 THEN 'riboseq;immunopeptidomics_ms' WHEN d.n_chars % 4 = 1 THEN 'immunopeptidomics_ms' WHEN d.n_chars % 4 = 2 THEN 'Proteomics;T-cell' ELSE 'predicted' END AS evidence_types,
  CASE WHEN d.n_chars % 3 = 0 THEN '0.001' WHEN d.n_chars % 3 = 1 THEN '0.01%' ELSE 'NR' END AS reported_fdr,
  CASE WHEN d.n_chars % 7 < 3 THEN '0.0004' ELSE 'not stated' END AS psm_qvalue, CASE WHEN d.n_chars % 11 = 0 THEN '4' ELSE NULL END AS accepted_decoys_in_class,
  CAST(d.n_chars % 4 AS STRING) AS n_unique_peptides, CAST(5 + d.n_chars % 9 AS STRING) AS ligand_len, CAST(7 + d.n_chars % 6 AS STRING) AS source_pep_len,
  CASE WHEN d.n_chars % 6 = 0 THEN 'not reported' ELSE CAST(d.n_chars % 100 AS STRING) || ' %' END AS periodicity_pct,
  CASE WHEN l.toxic IS NULL THEN 'not reported' WHEN d.n_chars % 3 = 0 THEN 'normal-rna-broad' ELSE 'normal-ligandome-broad' END AS tumor_specificity_modality,
  CASE WHEN l.toxic IS NULL THEN 'not stated' WHEN d.n_chars % 5 < 4 THEN 'per-claim-reported' ELSE 'cohort-inclusion-criterion' END AS tumor_specificity_scope,
  CASE WHEN l.toxic = 1 THEN 'detected-in-normal' WHEN l.toxic = 0 THEN 'absent-from-normal' ELSE 'not reported' END AS tumor_specificity_result,
  CASE WHEN l.quality IS NULL THEN 'MS-presented' WHEN d.n_chars % 13 = 0 THEN 'in-vivo' WHEN l.quality = 1 THEN 'T-cell-validated' ELSE 'validated_negative' END AS validation_level,
  'insufficient-info' AS meets_consensus_bar_as_reported, CASE WHEN d.n_chars % 2 = 0 THEN d.source ELSE '' END AS underlying_dataset_accession,
  CASE WHEN d.n_chars % 17 = 0 THEN 'hearsay' ELSE 'primary' END AS source_provenance, CASE WHEN d.n_chars % 19 = 0 THEN ' ' ELSE '10.1000/' || d.source END AS citation_doi_pmid,
  'Fig 1' AS citation_location, 'med' AS extraction_confidence, CASE WHEN d.lang = 'de' THEN 'cohort:' || d.source ELSE 'atlas' END AS _source
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
OCCURRENCES_SQL = "SELECT upper(w) AS seq, lang AS tissue, source AS gene FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w, lang, source FROM documents) WHERE regexp_full_match(w, '[A-Za-z]{6,12}')"
REFERENCES_SQL = "SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS text FROM benchmark"
NORMAL_SQL = "SELECT DISTINCT upper(w) AS seq FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM conversations) WHERE regexp_full_match(w, '[A-Za-z]{6,12}')"
PSMS_SQL = "SELECT CAST(event_id AS STRING) AS id, event_id, 'P' || CAST(user_id AS STRING) AS peptide, value AS score, event_type = 'error' AS is_decoy, CASE user_id % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'noncanonical' ELSE 'variant' END AS class, CASE user_id % 3 WHEN 0 THEN 'sp|' WHEN 1 THEN 'orf' ELSE 'ENSP' END || CAST(user_id AS STRING) AS accession, CAST(CAST(ts AS DATE) AS STRING) AS sample FROM events"
LENGTHS = list(range(6, 13))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims as CLAIMS says, by Columns of its own."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n, none = F.col("n_chars"), F.lit(None).cast("string")

    def by(rest: int, *values) -> Column:
        """The value at n_chars modulo `rest`; the last one for what is left, and for null."""
        pick = F.try_element_at(F.array(*[F.lit(v) for v in values]), (n % rest + 1).cast("int"))
        return F.when((n % rest < len(values) - 1), pick).otherwise(F.lit(values[-1]))

    lang = lambda rest, **names: F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("lang")], F.lit(rest))
    unlabelled, no_quality = F.col("toxic").isNull(), F.col("quality").isNull()
    pick = {
        "peptide_sequence": F.upper(F.coalesce(F.array_max(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), 0)), F.lit(""))),
        "orf_id_or_locus": F.concat("source", F.lit("_"), n.cast("string"), F.lit("aa")),
        "orf_class": lang("odd class", en="lncRNA-ORF", fr="uORF", de="altORF", es="pseudogene-ORF"),
        "antigen_type": by(2, "TSA", "TAA"),
        "cancer_type": F.col("lang"),
        "hla_allele": by(5, "HLA-A*02:01", " NA ", "not reported"),
        "evidence_types": by(4, "riboseq;immunopeptidomics_ms", "immunopeptidomics_ms", "Proteomics;T-cell", "predicted"),
        "reported_fdr": by(3, "0.001", "0.01%", "NR"),
        "psm_qvalue": by(7, "0.0004", "0.0004", "0.0004", "not stated"),
        "accepted_decoys_in_class": F.when(n % 11 == 0, "4").otherwise(none),
        "n_unique_peptides": (n % 4).cast("string"),
        "ligand_len": (5 + n % 9).cast("string"),
        "source_pep_len": (7 + n % 6).cast("string"),
        "periodicity_pct": F.when(n % 6 == 0, "not reported").otherwise(F.concat((n % 100).cast("string"), F.lit(" %"))),
        "tumor_specificity_modality": F.when(unlabelled, "not reported").otherwise(by(3, "normal-rna-broad", "normal-ligandome-broad")),
        "tumor_specificity_scope": F.when(unlabelled, "not stated").otherwise(F.when(n % 5 < 4, "per-claim-reported").otherwise("cohort-inclusion-criterion")),
        "tumor_specificity_result": F.when(F.col("toxic") == 1, "detected-in-normal").when(F.col("toxic") == 0, "absent-from-normal").otherwise("not reported"),
        "validation_level": F.when(no_quality, "MS-presented").when(n % 13 == 0, "in-vivo").when(F.col("quality") == 1, "T-cell-validated").otherwise("validated_negative"),
        "meets_consensus_bar_as_reported": F.lit("insufficient-info"),
        "underlying_dataset_accession": F.when(n % 2 == 0, F.col("source")).otherwise(""),
        "source_provenance": by(17, "hearsay", "primary"),
        "citation_doi_pmid": F.when(n % 19 == 0, " ").otherwise(F.concat(F.lit("10.1000/"), "source")),
        "citation_location": F.lit("Fig 1"),
        "extraction_confidence": F.lit("med"),
        "_source": F.when(F.col("lang") == "de", F.concat(F.lit("cohort:"), "source")).otherwise("atlas"),
    }
    return t.select(F.col("doc_id").alias("claim_id"), *[c.alias(name) for name, c in pick.items()])


CLAIMS_SQL = CLAIMS.format(documents="documents", labels="labels", last_word="list_max(regexp_extract_all(d.text, '[A-Za-z]{7,}'))")


def _words(df: DataFrame, *keep) -> DataFrame:
    return df.select(F.explode(F.split("text", "[ \n]+")).alias("w"), *keep).where(F.col("w").rlike("^[A-Za-z]{6,12}$")).withColumn("seq", F.upper("w")).drop("w")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(table(spark, sf_dir, "documents"), F.col("lang").alias("tissue"), F.col("source").alias("gene"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("text"))


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(table(spark, sf_dir, "conversations")).distinct()


def psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    kind = lambda a, b, c: F.when(u % 3 == 0, a).when(u % 3 == 1, b).otherwise(c)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), "event_id", F.concat(F.lit("P"), u.cast("string")).alias("peptide"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("is_decoy"),
        kind("canonical", "noncanonical", "variant").alias("class"), F.concat(kind("sp|", "orf", "ENSP"), u.cast("string")).alias("accession"), F.col("ts").cast("date").cast("string").alias("sample"),
    )
