"""Sinks (K1-K5, K7, K8, H1). Parquet is for tables between steps; these are for what leaves."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata import config as C


def with_defaults(df: DataFrame) -> DataFrame:
    """H1: all claim columns; what a source doesn't give is not reported."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(C.NOT_REPORTED)).alias(c) if c in df.columns else F.lit(C.NOT_REPORTED).alias(c) for c in C.CLAIM_COLUMNS], *[c for c in C.LINEAGE_COLUMNS if c in df.columns])


def catalogue(df: DataFrame, path: str) -> None:
    """K1."""
    with_defaults(df).write.mode("overwrite").csv(path, header=True, escape='"')


def sorted_table(df: DataFrame, path: str, by: str) -> None:
    """K2, K6: files in order of `by`, each a range of it."""
    df.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").csv(path, header=True, escape='"')


def by_class(df: DataFrame, path: str, group: str = "class") -> DataFrame:
    """K5: a folder for each class; returns the manifest."""
    df.write.mode("overwrite").partitionBy(group).csv(path, header=True, sep="\t")
    return df.groupBy(group).agg(F.count("*").alias("rows"))


def report(df: DataFrame, meta: dict, digits: int = 5, most: int = 10_000) -> str:
    """K3, K7: a small result and its metadata as JSON, floats rounded; a large result is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are a table, not a report")
    tidy = lambda v: round(v, digits) if isinstance(v, float) else v
    return json.dumps({"meta": meta, "rows": [{k: tidy(v) for k, v in r.asDict(True).items()} for r in rows]}, default=str, sort_keys=True)


def ledger_files(ledger: DataFrame, meta: dict, path: str, extra: dict[str, DataFrame] | None = None) -> dict:
    """K3: one ledger as a JSON file (meta, rows, and small tables `extra` by name) and as a TSV table with the meta columns in every row.
    Returns what the JSON says. `meta` names analysis_id, software, unit, alpha and fdr_convention."""
    spark = ledger.sparkSession
    rows = sorted(json.loads(report(ledger, {}))["rows"], key=lambda r: str(r["class"]))
    out = {"meta": meta, "ledger": rows} | {k: json.loads(report(t, {}))["rows"] for k, t in (extra or {}).items()}
    spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path + ".json")
    lead = [F.lit(str(meta[c])).alias(c) for c in ("analysis_id", "software", "unit", "alpha", "fdr_convention")]
    table = ledger.select(*lead, "class", "n_target", "n_decoy", F.round("class_fdr", 5).alias("class_fdr"), F.round("share", 5).alias("share"), "all_target", "all_decoy")
    table.coalesce(1).sortWithinPartitions("class").write.mode("overwrite").csv(path + ".tsv", header=True, sep="\t")  # a row a class
    return out


def bars(df: DataFrame, label: str, value: str, width: int = 40, most: int = 200) -> str:
    """K8: a small report as lines of text with a bar each, in the order of the rows."""
    rows = [(str(r[label]), float(r[value] or 0)) for r in df.select(label, value).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are a table, not a report")
    top, pad = max((v for _, v in rows), default=0) or 1, max((len(x) for x, _ in rows), default=0)
    return "\n".join(f"{x:<{pad}} {v:>12,.0f} {'#' * round(width * v / top)}" for x, v in rows)
