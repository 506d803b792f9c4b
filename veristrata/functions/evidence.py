"""Evidence dimensions (P5-P14, P25): each a struct of five rungs and an outcome. "Not reported" is a state, never a negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veristrata import config as C
from veristrata.functions.columns import any_of, num, present, reported, txt

SUPPORTS, CONTRADICTS, INDIRECT, NOT_ADJUDICABLE = "supports", "contradicts", "indirect", "not-adjudicable"


def _has(texts: Column, words: list[str]) -> Column:
    return any_of([texts.contains(w) for w in words])


def _yes(c) -> Column:
    return F.coalesce(c, F.lit(False)) if isinstance(c, Column) else F.lit(c)


def rung(asserted, claim_linked, quantitative, modality, outcome) -> Column:
    """P5: the outcome counts only where all four hold."""
    a, b, c, d = (_yes(x) for x in (asserted, claim_linked, quantitative, modality))
    ok = a & b & c & d
    return F.struct(a.alias("asserted"), b.alias("claim_linked"), c.alias("quantitative"), d.alias("modality_appropriate"), ok.alias("adjudicable"), F.when(ok, outcome).otherwise(NOT_ADJUDICABLE).alias("outcome"))


def source_translation() -> Column:
    """By ribosome profiling first, else by proteomics."""
    ev = txt(F.col("evidence_types"))
    ribo, ms = ev.contains("ribo"), _has(ev, ["immunopeptidom", "proteomic", "ms"])
    per, fdr, n, length = (num(F.col(c)) for c in ("periodicity_pct", "reported_fdr", "n_unique_peptides", "source_pep_len"))
    by_ribo = ribo & per.isNotNull()
    by_protein = fdr.isNotNull() & n.isNotNull() & length.isNotNull()
    good = F.when(by_ribo, per >= C.MIN_PERIODICITY).otherwise((fdr <= C.MAX_SOURCE_FDR) & (n >= C.MIN_SOURCE_PEPTIDES) & (length >= C.MIN_SOURCE_PEP_LEN))
    return rung(ribo | ms, ribo | ms, by_ribo | by_protein, ribo | ms, F.when(good, SUPPORTS).otherwise(CONTRADICTS))


def _eluted() -> Column:
    return _has(txt(F.col("evidence_types")), ["immunopeptidom", "eluted", "hla-ms"])


def hla_elution() -> Column:
    """Prediction alone asserts, but is not the right modality."""
    el, n = _eluted(), num(F.col("ligand_len"))
    predicted = txt(F.col("evidence_types")).contains("predict") & ~el
    return rung(el | predicted, el & reported(F.col("peptide_sequence")), n.isNotNull(), el, F.when(n.between(*C.LIGAND_LEN), SUPPORTS).otherwise(INDIRECT))


def allele_restriction() -> Column:
    """P8."""
    el, known = _eluted(), reported(F.col("hla_allele"))
    return rung(el, known, known, el, F.when(known, SUPPORTS).otherwise(NOT_ADJUDICABLE))


def normal_presentation() -> Column:
    """Only a normal ligandome, reported for the claim, can answer."""
    modality, scope, result = (txt(F.col(f"tumor_specificity_{c}")) for c in ("modality", "scope", "result"))
    linked = (scope == "per-claim-reported") & result.isin("absent-from-normal", "detected-in-normal")
    return rung(modality.isin(C.ALL_MODALITIES), linked, linked, modality.isin(C.LIGANDOME_MODALITIES), F.when(result == "detected-in-normal", CONTRADICTS).otherwise(SUPPORTS))


def normal_presentation_state() -> Column:
    modality, scope, result = (txt(F.col(f"tumor_specificity_{c}")) for c in ("modality", "scope", "result"))
    return (
        F.when(result == "detected-in-normal", "explicit-normal-detection").when(~modality.isin(C.ALL_MODALITIES), "not-reported")
        .when(modality.isin(C.LIGANDOME_MODALITIES) & (scope == "per-claim-reported"), "modality-appropriate-claim-linked").otherwise("indirect")
    )


def human_tcell_assay() -> Column:
    """P10: a claim that was never assayed is never a negative."""
    level, ev = txt(F.col("validation_level")), txt(F.col("evidence_types"))
    known = level.isin("t-cell-validated", "validated_negative", "in-vivo")
    return rung(known | ev.contains("t-cell"), known, known, level != "in-vivo", F.when(level == "t-cell-validated", SUPPORTS).otherwise(CONTRADICTS))


def human_tcell_state() -> Column:
    level, ev = txt(F.col("validation_level")), txt(F.col("evidence_types"))
    return (
        F.when(level == "t-cell-validated", "human-assay-positive").when(level == "validated_negative", "human-assay-negative")
        .when(level == "in-vivo", "nonhuman-assay-indirect").when(ev.contains("t-cell"), "assayed-result-not-claim-linked").otherwise("not-assayed")
    )


def class_fdr_reconstructible() -> Column:
    """Needs the accepted decoys of the class."""
    ms = _has(txt(F.col("evidence_types")), ["immunopeptidom", "proteomic", "ms"])
    q, d = num(F.col("psm_qvalue")), reported(F.col("accepted_decoys_in_class"))
    return rung(ms, q.isNotNull(), q.isNotNull(), d, F.when(d, SUPPORTS).otherwise(NOT_ADJUDICABLE))


def all_dimensions() -> list[Column]:
    """The six structs, named."""
    made = [source_translation(), hla_elution(), allele_restriction(), normal_presentation(), human_tcell_assay(), class_fdr_reconstructible()]
    return [c.alias(n) for c, n in zip(made, C.DIMENSIONS, strict=True)]


def stratum() -> Column:
    """T-cell-tested beats cohort beats atlas."""
    tested = human_tcell_state() != "not-assayed"
    return F.when(tested, "3. T-cell-tested").when(F.trim(F.coalesce(F.col("_source"), F.lit(""))).startswith("cohort:"), "2. end-to-end cohort").otherwise("1. atlas ligand record")


def problems() -> Column:
    """What is wrong with a claim row (columns that are missing altogether: see gates.missing_columns)."""
    tests = []
    for name, allowed in C.VOCABULARY.items():
        v = F.trim(F.coalesce(F.col(name), F.lit("")))
        tests.append(F.when((v != "") & ~v.isin(allowed), F.lit(f"{name} not in vocabulary")))
    tests.append(F.when(F.trim(F.coalesce(F.col("citation_doi_pmid"), F.lit(""))) == "", F.lit("citation_doi_pmid is required")))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def reuse_score() -> Column:
    return sum((present(F.col(c)).cast("int") for c in C.REUSE_FIELDS[1:]), present(F.col(C.REUSE_FIELDS[0])).cast("int"))


def peptide_tier(canonical: Column, normal: Column) -> Column:
    """P25, on the flags of peptide_flags."""
    return (
        F.when(canonical, "0_canonical-self").when(normal, "1_normal-present").when(~F.col("allele"), "2_provenance-clean")
        .when(~F.col("source_rigor_reported"), "3_actionable-presentation").when(~F.col("immuno_reported"), "4_translation-stat-reported").otherwise("5_immunogenicity-reported")
    )
