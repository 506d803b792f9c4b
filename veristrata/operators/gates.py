"""Quality gates (G1-G16): checks that raise. Nothing is repaired and nothing skipped in silence."""

from __future__ import annotations

import ast
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata import config as C
from veristrata.functions.columns import plain_text
from veristrata.operators.phrases import find_phrases


class GateError(AssertionError):
    pass


def require(ok: bool, what: str) -> None:
    if not ok:
        raise GateError(what)


def missing_columns(df: DataFrame) -> list[str]:
    """Claim columns that the schema lacks."""
    return [c for c in C.CLAIM_COLUMNS if c not in df.columns]


def no_retired_columns(df: DataFrame) -> None:
    """G2."""
    require(not (old := [c for c in C.RETIRED_COLUMNS if c in df.columns]), f"retired columns: {old}")


def one_reader_of(fields: list[str], root: Path, allowed: set[str]) -> list[str]:
    """G1: modules other than the allowed ones that compare evidence fields."""
    found = []
    for p in sorted(root.rglob("*.py")):
        for node in ast.walk(ast.parse(p.read_text())):
            if isinstance(node, ast.Compare) and any(isinstance(x, ast.Constant) and x.value in fields for x in ast.walk(node)) and p.name not in allowed:
                found.append(f"{p.name}:{node.lineno}")
    return found


def expansion_holds(figures: DataFrame) -> None:
    """Every peptide of a source cell has its claim, no gene-level row carries one, and every claim has its source row. figures: the row
    of claims.expansion."""
    r = figures.first()
    require(r.peptide_claims == r.expected, f"expansion lost rows: {r.peptide_claims} claims of {r.expected} peptides")
    require(r.gene_level_with_peptide == 0, f"{r.gene_level_with_peptide} gene-level rows carry a peptide")
    require(r.without_lineage == 0, f"{r.without_lineage} claims without a source row")


def prose_problems(texts: DataFrame, required: list[str], banned: list[str], exempt: str, section: str | None = None, text: str = "value") -> DataFrame:
    """(problem, phrase, n): required phrases that no text has, and how often lines assert a banned phrase, in any case. Lines that match
    `exempt` say that a phrase is withdrawn; a section whose heading matches `section` is left out, up to the next heading."""
    spark = texts.sparkSession
    body = F.col(text)
    if section:
        body = F.regexp_replace(body, rf"(?ims)^##+[^\S\n]*{section}.*?(?=^##|\z)", "")
    lines = texts.select(F.explode(F.split(body, "\n")).alias("line")).where(~F.lower("line").rlike(exempt.lower()))
    asserted = find_phrases(lines, banned, "line").groupBy("phrase").agg(F.count("*").alias("n")).select(F.lit("asserted").alias("problem"), "phrase", "n")
    wanted = spark.createDataFrame([(p,) for p in sorted(set(required))], "phrase string")
    missing = wanted.join(find_phrases(texts, required, text, ignore_case=False).select("phrase").distinct(), "phrase", "left_anti")
    return missing.select(F.lit("missing").alias("problem"), "phrase", F.lit(1).cast("long").alias("n")).unionAll(asserted)


def numbers_hold(texts: DataFrame, numbers: dict[str, str], text: str = "value") -> list[str]:
    """Labels whose number, written as it must stand in the prose, no text has."""
    labels = {n: label for label, n in numbers.items()}
    return sorted(labels[r.phrase] for r in prose_problems(texts, list(labels), [], "$^", text=text).collect())


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """G12."""
    require(not df.isEmpty(), f"no rows: {what}")
    return df


def near(value: float, expected: float, tolerance: float, what: str) -> None:
    """G10."""
    require(abs(value - expected) <= tolerance, f"{what}: {value} is not {expected} within {tolerance}")


def at_least(value: float, least: float, what: str) -> None:
    """G15."""
    require(value >= least, f"{what}: {value} < {least}")


def same(a: DataFrame, b: DataFrame, key: str, value: str) -> int:
    """Keys whose values differ or that one side lacks; none may."""
    t = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    n = t.where(~F.col("_a").eqNullSafe(F.col("_b"))).count()
    require(n == 0, f"{n} keys differ in {value}")
    return n


def partition(df: DataFrame, parts: list[Column], what: str) -> None:
    """Every row is in one part."""
    n = df.where(sum((p.cast("int") for p in parts), F.lit(0)) != 1).count()
    require(n == 0, f"{what}: {n} rows are not in exactly one part")


def monotone_ladder(ladder: DataFrame) -> None:
    """No rung holds more claims than the one before it."""
    t = {(r.dimension, r.rung): r.n for r in ladder.collect()}
    for d in C.DIMENSIONS:
        for a, b in zip(C.RUNGS, C.RUNGS[1:], strict=False):
            require(t[d, a] >= t[d, b], f"{d}: {b} exceeds {a}")


def same_unit(*units: str) -> None:
    """Rates of different units are never combined."""
    require(len(set(units)) == 1, f"rates of different units: {units}")


def quotes_present(texts: DataFrame, column: str, quotes: list[str]) -> DataFrame:
    """(quote, n): texts that hold each quote after tags and white space are normalised."""
    t = texts.select(plain_text(F.col(column)).alias("t"), F.monotonically_increasing_id().alias("_row"))
    found = find_phrases(t, quotes, "t", ["_row"], ignore_case=False)
    per = found.groupBy("phrase").agg(F.count_distinct("_row").alias("n"))
    wanted = texts.sparkSession.createDataFrame([(q,) for q in sorted(set(quotes))], "phrase string")
    return wanted.join(per, "phrase", "left").select(F.col("phrase").alias("quote"), F.coalesce("n", F.lit(0)).alias("n"))
