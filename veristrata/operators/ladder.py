"""Cumulative ladders, cascades and rollups of claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata import config as C
from veristrata.functions import evidence as E
from veristrata.functions.columns import num, present, txt


def scored(claims: DataFrame) -> DataFrame:
    """Claims with the six dimensions."""
    return claims.select("*", *E.all_dimensions())


def ladder(scored_claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1, A3: (by..., dimension, rung, n): claims that reach each rung and all before it, and claims by outcome, in one pass."""
    sums, names = [], []
    for d in C.DIMENSIONS:
        for k, _ in enumerate(C.RUNGS):
            test = reduce(lambda a, b: a & b, [F.col(f"{d}.{r}") for r in C.RUNGS[: k + 1]])
            sums.append(F.sum(test.cast("long")))
            names.append((d, C.RUNGS[k]))
        for o in (E.SUPPORTS, E.CONTRADICTS, E.INDIRECT):
            sums.append(F.sum((F.col(f"{d}.outcome") == o).cast("long")))
            names.append((d, o))
    one = scored_claims.groupBy(*(by or [])).agg(*[s.alias(f"v{i}") for i, s in enumerate(sums)])
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(r).alias("rung"), F.coalesce(F.col(f"v{i}"), F.lit(0)).alias("n")) for i, (d, r) in enumerate(names)])
    return one.select(*(by or []), F.explode(pairs).alias("x")).select(*(by or []), "x.dimension", "x.rung", "x.n")


def counts(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """A2."""
    return df.groupBy(*by).agg(F.count("*").alias(name))


def peptide_flags(scored_claims: DataFrame, sequence: str = "peptide_sequence", control: Column | None = None) -> DataFrame:
    """A4: for each sequence (control rows apart) whether any claim reports or substantiates each thing, and the best reuse score.

    specificity_strict is set by adjudicability, unlike its siblings, which need a supporting outcome."""
    seq = F.upper(F.trim(F.coalesce(F.col(sequence), F.lit(""))))
    rows = scored_claims.select("*", seq.alias("seq"), (control if control is not None else F.lit(False)).alias("is_control")).where(F.col("seq").rlike(r"^\p{L}+$"))
    flag = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    return rows.groupBy("seq", "is_control").agg(
        flag(present(F.col("hla_allele")), "allele"), flag(present(F.col("periodicity_pct")) | present(F.col("reported_fdr")), "source_rigor_reported"),
        flag(present(F.col("tumor_specificity_modality")), "specificity_reported"), flag(present(F.col("validation_level")), "immuno_reported"),
        flag(F.col("source_translation.outcome") == E.SUPPORTS, "source_strict"), flag(F.col("hla_elution.outcome") == E.SUPPORTS, "hla_strict"),
        flag(F.col("normal_presentation.adjudicable"), "specificity_strict"), flag(F.col("human_tcell_assay.outcome") == E.SUPPORTS, "immuno_strict"),
        flag(F.col("source_translation.adjudicable"), "source_decidable"), flag(F.col("normal_presentation.adjudicable"), "specificity_decidable"),
        F.max(E.reuse_score()).cast("long").alias("reuse"),
    )


def cascade(df: DataFrame, stages: list[tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """(stage, n) rows that pass each stage and all before it."""
    tests = [reduce(lambda a, b: a & b, [c for _, c in stages[: i + 1]]) for i in range(len(stages))]
    one = df.groupBy(*(by or [])).agg(*[F.sum(t.cast("long")).alias(f"v{i}") for i, t in enumerate(tests)])
    pairs = F.array(*[F.struct(F.lit(n).alias("stage"), F.coalesce(F.col(f"v{i}"), F.lit(0)).alias("n")) for i, (n, _) in enumerate(stages)])
    return one.select(*(by or []), F.explode(pairs).alias("x")).select(*(by or []), "x.stage", "x.n")


def leniency(scored_claims: DataFrame) -> DataFrame:
    """One row: claims that each relaxation of a criterion would let adjudicate."""
    state = E.human_tcell_state()
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    modality = txt(F.col("tumor_specificity_modality"))
    return scored_claims.agg(
        F.count("*").alias("claims"), n(F.col("source_translation.adjudicable"), "translation_strict"), n(num(F.col("reported_fdr")).isNotNull(), "any_fdr"),
        n(num(F.col("periodicity_pct")).isNotNull(), "any_periodicity"), n(num(F.col("psm_qvalue")).isNotNull(), "any_qvalue"), n(txt(F.col("evidence_types")).contains("ribo"), "binary_ribo"),
        n(F.col("allele_restriction.claim_linked"), "allele"), n(F.col("normal_presentation.adjudicable"), "ligandome_claim"), n(modality.isin(C.LIGANDOME_MODALITIES), "any_ligandome"),
        n(modality.isin(C.ALL_MODALITIES), "any_modality"), n(F.col("human_tcell_assay.adjudicable"), "tcell_strict"), n(state == "human-assay-positive", "tcell_positive"),
        n(state == "nonhuman-assay-indirect", "tcell_nonhuman"), n(state == "assayed-result-not-claim-linked", "tcell_not_linked"),
    )


def first_by_key(df: DataFrame, key: str, order: str, keep_empty: Column | None = None) -> DataFrame:
    """The first row of each key; rows where keep_empty holds (no key) all stay. They get keys of their own, so a
    key that is often missing doesn't meet in one task."""
    empty = keep_empty if keep_empty is not None else F.lit(False)
    own = df.withColumn("_key", F.when(empty, F.concat(F.lit("\0"), F.col(order).cast("string"))).otherwise(F.col(key).cast("string")))
    least = own.groupBy("_key").agg(F.min(order).alias(order))
    return own.join(least, ["_key", order], "left_semi").drop("_key")


def first_value(df: DataFrame, key: list[str], value: str, order: str, last: bool = False) -> DataFrame:
    """The value of the first (or last) row of each key."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*key).agg(pick(value, order).alias(value))
