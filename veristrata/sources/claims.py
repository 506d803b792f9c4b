"""From what sources say to claim rows (S3-S7 mapped, H2-H8): every claim column filled, what a source doesn't report named so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata import config as C
from veristrata.functions import columns as K
from veristrata.operators.ladder import first_value
from veristrata.sources.readers import atlas_sequences, headered_csv, positional

_LETTERS = r"^\p{L}+$"


def _or_nr(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(C.NOT_REPORTED))


def claim_rows(df: DataFrame, values: dict[str, Column | str], source: str, keep: list[str] | None = None) -> DataFrame:
    """All claim columns of C.CLAIM_COLUMNS from `values` (Columns of df, or texts), `_source`, and lineage columns `keep` of df."""
    of = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(*[_or_nr(of(values.get(c, C.NOT_REPORTED))).alias(c) for c in C.CLAIM_COLUMNS], *(keep or []), F.lit(source).alias("_source"))


def whole_number(c: Column, otherwise: Column) -> Column:
    """A number's whole part as text, or another number where it is none."""
    return F.coalesce(F.trim(c).try_cast("double").try_cast("int"), otherwise).cast("string")


def epitope_atlas(spark: SparkSession, path: str, accession: str, citation: str, location: str) -> DataFrame:
    """S3: (sequence, length, ORF, tissue) by place; nothing is said of class or specificity."""
    t = atlas_sequences(spark, path)
    return claim_rows(t, {"peptide_sequence": F.col("seq"), "orf_id_or_locus": F.col("orf_id"), "orf_class": "other", "antigen_type": "TSA", "cancer_type": F.col("tissue"), "evidence_types": "immunopeptidomics", "ligand_len": F.col("length"),
        "validation_level": "MS-presented", "underlying_dataset_accession": accession, "citation_doi_pmid": citation, "citation_location": location}, accession)


def peptide_table(spark: SparkSession, path: str, accession: str, citation: str, location: str) -> DataFrame:
    """A table with a header: Peptide, gene.symbol, type, Peptide length."""
    t = headered_csv(spark, path, ["Peptide", "gene.symbol", "type", "Peptide length"]).withColumn("seq", F.upper(F.trim("Peptide"))).where(F.col("seq").rlike(_LETTERS))
    length = F.coalesce(F.nullif(F.col("Peptide length"), F.lit("")), F.length("seq").cast("string"))
    return claim_rows(t, {"peptide_sequence": F.col("seq"), "orf_id_or_locus": F.col("`gene.symbol`"), "orf_class": K.class_of_atlas(F.col("type")), "antigen_type": "TSA", "evidence_types": "immunopeptidomics", "ligand_len": length,
        "validation_level": "MS-presented", "underlying_dataset_accession": accession, "citation_doi_pmid": citation, "citation_location": location}, accession)


def epitope_table(spark: SparkSession, path: str, accession: str, citation: str, location: str) -> DataFrame:
    """17 fields by place, as the header is out of step: 0 sequence, 1 cancer, 2 allele, 6 length, 8 gene, 10 low in normal tissue, 16 type."""
    t = positional(spark, path, 17, min_fields=17, sep=",").withColumn("seq", F.upper(F.trim("_c0"))).where(F.col("seq").rlike(_LETTERS))
    low = F.lower(F.trim(F.coalesce("_c10", F.lit("")))) == "yes"
    return claim_rows(t, {"peptide_sequence": F.col("seq"), "orf_id_or_locus": F.col("_c8"), "orf_class": K.class_of_atlas(F.col("_c16")), "antigen_type": "TSA", "cancer_type": F.col("_c1"), "hla_allele": F.col("_c2"),
        "evidence_types": "immunopeptidomics, MHC binding prediction", "ligand_len": whole_number(F.col("_c6"), F.length("seq")), "tumor_specificity_modality": "normal-rna-broad", "tumor_specificity_scope": "per-claim-reported",
        "tumor_specificity_result": F.when(low, "absent-from-normal").otherwise("detected-in-normal"), "validation_level": "MS-presented", "underlying_dataset_accession": accession, "citation_doi_pmid": citation, "citation_location": location}, accession)


def expand_genes(genes: DataFrame, values: dict[str, Column | str], source: str, row: str = "_row", gene: str = "gene", biotype: str = "biotype", cell: str = "cell", best_q: DataFrame | None = None) -> DataFrame:
    """One claim for each peptide of a gene row's cell, with its lineage; a row without any stays as one gene-level claim.

    best_q: (peptide, q), the lowest q of each peptide of another sheet (decoy.best_q). Control genes are TAA.
    """
    t = genes.withColumn("_peps", K.peptides(F.col(cell))).withColumn("_n", F.size("_peps"))
    t = t.select("*", F.posexplode_outer(F.when(F.col("_n") > 0, F.col("_peps"))).alias("_at", "_pep"))
    if best_q is not None:
        t = t.join(best_q.select(F.col("peptide").alias("_pep"), F.col("q").alias("_q")), "_pep", "left")
    else:
        t = t.withColumn("_q", F.lit(None).cast("double"))
    control = K.is_control(F.col(gene), F.col(biotype))
    lineage = [
        F.when(control, "yes").otherwise("no").alias("_canonical"), F.when(F.col("_pep").isNull(), "gene-level").otherwise("peptide-source-claim").alias("_claim_unit"), F.col(row).cast("string").alias("_source_row"),
        _or_nr(F.col(gene)).alias("_source_gene"), F.coalesce("_at", F.lit(0)).alias("_pep_index"), F.col("_n").alias("_n_peps_in_source_row"), _or_nr(F.col(biotype)).alias("_source_class_raw"),
    ]
    own = {"peptide_sequence": F.col("_pep"), "orf_id_or_locus": F.col(gene), "orf_class": K.class_of_biotype(F.col(biotype)), "antigen_type": F.when(control, "TAA").otherwise("TSA"), "evidence_types": "immunopeptidomics",
        "n_unique_peptides": F.when(F.col("_n") > 0, F.col("_n")), "ligand_len": F.length("_pep"), "psm_qvalue": F.col("_q"), "validation_level": "MS-presented"}
    return claim_rows(t, own | values, source, lineage)


def expansion(claims: DataFrame) -> DataFrame:
    """G8's figures, one row: source rows, claims of each unit, peptides expected, and what must not be: peptides of gene-level rows, claims
    without a source row."""
    gene, peptide = F.col("_claim_unit") == "gene-level", F.col("_claim_unit") == "peptide-source-claim"
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return claims.agg(
        F.count_distinct("_source_row").alias("source_rows"), n(peptide).alias("peptide_claims"), n(gene).alias("gene_level"), F.coalesce(F.sum(F.when(peptide & (F.col("_pep_index") == 0), F.col("_n_peps_in_source_row"))), F.lit(0)).cast("long").alias("expected"),
        n(gene & (F.col("peptide_sequence") != C.NOT_REPORTED)).alias("gene_level_with_peptide"), n(F.col("_source_row").isNull()).alias("without_lineage"),
        F.count_distinct(F.when(peptide, F.col("peptide_sequence"))).alias("unique_peptides"), (n(peptide) - F.count_distinct(F.when(peptide, F.struct("_source_gene", "peptide_sequence")))).alias("duplicates"),
    )


def cohort_sequences(claims: DataFrame, cohort: str = "citation_doi_pmid") -> DataFrame:
    """H5: (cohort, seq, orf_class): the sequences of each cohort, controls left out, with the class of the first row."""
    t = _cohort_rows(claims).where(F.col("seq").rlike(_LETTERS))
    return first_value(t, [cohort, "seq"], "orf_class", "_row_idx")


def cohort_dropped(claims: DataFrame, cohort: str = "citation_doi_pmid") -> DataFrame:
    """H5: (cohort, dropped): rows of each cohort that report no sequence."""
    t = _cohort_rows(claims)
    return t.groupBy(cohort).agg(F.sum((~F.coalesce(F.col("seq").rlike(_LETTERS), F.lit(False))).cast("long")).alias("dropped"))


def _cohort_rows(claims: DataFrame) -> DataFrame:
    return claims.where(F.coalesce(F.col("_canonical"), F.lit("")) != "yes").withColumn("seq", F.upper(F.trim(F.coalesce("peptide_sequence", F.lit("")))))


def target_subset(claims: DataFrame, cohort: str, classes: list[str], flag: str = "no") -> DataFrame:
    """H6: (seq, locus, claims): sequences of a cohort and some classes with their first locus and their number of claims."""
    t = claims.where((F.col("citation_doi_pmid") == cohort) & F.col("orf_class").isin(classes) & (F.coalesce(F.col("_canonical"), F.lit("no")) == flag)).withColumn("seq", F.upper(F.trim("peptide_sequence"))).where(F.col("seq").rlike(_LETTERS))
    return t.groupBy("seq").agg(F.min_by("orf_id_or_locus", "_row_idx").alias("locus"), F.count("*").alias("claims"))


def gene_sequences(proteins: DataFrame) -> DataFrame:
    """H8: (gene, seq) of proteins that name a gene, in upper case."""
    return proteins.where("gene is not null").select(F.upper("gene").alias("gene"), "seq").distinct()
