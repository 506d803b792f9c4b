"""Identifier cascades and expression joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.functions.columns import tissue_tier


def unique_only(lookup: DataFrame, name: str, ident: str) -> DataFrame:
    """Names that lead to one id only."""
    return lookup.groupBy(name).agg(F.count_distinct(ident).alias("_n"), F.min(ident).alias(ident)).where("_n = 1").drop("_n")


def cascade_lookup(df: DataFrame, key: str, tables: list[tuple[str, DataFrame]], name: str = "name", ident: str = "id") -> DataFrame:
    """Id and route of the first table that has the key; tables: (route, (name, id)), one id a name."""
    out, ids, routes = df, [], []
    for route, t in tables:
        col = f"_{route}"
        out = out.join(t.select(F.col(name).alias(key), F.col(ident).alias(col)), key, "left")
        ids.append(F.col(col))
        routes.append(F.when(F.col(col).isNotNull(), route))
    return out.select(*df.columns, F.coalesce(*ids).alias(ident), F.coalesce(*routes).alias("route"))


def symbol_to_gene(df: DataFrame, key: str, info: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Df with `id` and `route` of its symbol through the registries, in this order: a current symbol (symbol), another registry's symbols,
    former ones and aliases (registry), a synonym that only one gene has (synonym), a name of the annotation whose gene id some
    gene refers to (annotation). Case and blanks at the ends don't count; an empty symbol has no gene.

    info: (gene_id, kind, name, _row_idx) of readers.gene_info, where the last row of a symbol or reference counts; symbols: (name,
    gene_id, kind) of readers.hgnc; names: (gene_name, gene_id) of readers.gene_names, whose ids are the references.
    """
    upper = F.upper(F.trim("name")).alias("name")
    kind = lambda k: info.where(F.col("kind") == k)
    last = lambda t: t.groupBy("name").agg(F.max_by("id", "_row_idx").alias("id"))
    symbol = last(kind("symbol").select(upper, F.col("gene_id").alias("id"), "_row_idx"))
    registry = symbols.groupBy(upper).agg(F.min_by("gene_id", F.struct("kind", "gene_id")).alias("id"))
    synonym = unique_only(kind("synonym").select(upper, F.col("gene_id").alias("id")), "name", "id")
    reference = last(kind("xref").select(F.col("name"), F.col("gene_id").alias("id"), "_row_idx"))
    annotation = names.select(F.upper("gene_name").alias("own"), F.col("gene_id").alias("name")).join(reference, "name").groupBy(F.col("own").alias("name")).agg(F.max("id").alias("id"))
    own = df.withColumn("_key", F.nullif(F.upper(F.trim(F.coalesce(F.col(key), F.lit("")))), F.lit("")))
    return cascade_lookup(own, "_key", [("symbol", symbol), ("registry", registry), ("synonym", synonym), ("annotation", annotation)]).drop("_key")


def first_route(parts: list[tuple[str, DataFrame]], key: str, value: str, order: str) -> DataFrame:
    """H7: (key, value, route): of the first route, and in it of the first row, that has a value for the key."""
    every = None
    for rank, (route, t) in enumerate(parts):
        own = t.where(F.col(value).isNotNull()).select(key, value, F.struct(F.lit(rank).alias("rank"), F.col(order).alias("order")).alias("_at"), F.lit(route).alias("route"))
        every = own if every is None else every.unionAll(own)
    return every.groupBy(key).agg(F.min_by(F.struct(value, "route"), "_at").alias("x")).select(key, f"x.{value}", "x.route")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """H7: one row: rows in which both routes have a value, and those in which it is the same."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return df.agg(n(both, "both"), n(both & (F.col(a) == F.col(b)), "agree"))


def tier_contamination(df: DataFrame, sequence: str, tissue: str) -> tuple[DataFrame, DataFrame]:
    """P21 for sequences that span tiers: (tier, n), a sequence once in each of its tiers, other tissues under their own names; and one row:
    sequences, those in some critical tissue, those in none but immune and privileged ones."""
    t = tissue_tier(F.col(tissue))
    tier = F.when(t == "OTHER", F.concat(F.lit("OTHER:"), F.lower(F.trim(F.coalesce(F.col(tissue), F.lit("")))))).otherwise(t).alias("tier")
    pairs = df.select(sequence, tier).distinct()
    per = pairs.groupBy(sequence).agg(F.bool_or(F.col("tier") == "CRITICAL").alias("c"), F.bool_and(F.col("tier").isin("IMMUNE", "PRIVILEGED")).alias("p"))
    n = lambda c, name: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(name)
    return pairs.groupBy("tier").agg(F.count("*").alias("n")), per.agg(F.count("*").alias("n"), n("c", "critical"), n("p", "tolerated"))


def last_wins(base: DataFrame, override: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Base with the value of the last override row of each key, where there is one."""
    last = override.groupBy(key).agg(F.max_by(value, order).alias("_v"))
    return base.join(last, key, "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


def linked_value(items: DataFrame, links: DataFrame, by_id: DataFrame, by_gene: DataFrame, entry: str, ident: str, gene: str, value: str) -> DataFrame:
    """Items with the greatest value among the ids that an official link gives their entry, else that of their gene, and `via`: link,
    gene or null. links: (entry, ident); by_id: (ident, value); by_gene: (gene, value), one row each. Items are only looked
    up, so the maxima are made before they meet."""
    official = links.join(by_id, ident).groupBy(entry).agg(F.max(value).alias("_l"))
    t = items.join(official, entry, "left").join(by_gene.select(gene, F.col(value).alias("_g")), gene, "left")
    via = F.when(F.col("_l").isNotNull(), "link").when(F.col("_g").isNotNull(), "gene")
    return t.select(*items.columns, F.coalesce("_l", "_g").alias(value), via.alias("via"))


def unattached(expected: DataFrame, attached: DataFrame, key: str) -> DataFrame:
    """Expected keys that nothing is attached to."""
    return expected.select(key).distinct().join(attached.select(key).distinct(), key, "left_anti")


def vector_max(items: DataFrame, vectors: DataFrame, item: str, gene: str, vector: str) -> DataFrame:
    """Element-wise maximum of the vectors of an item's genes, through the long form."""
    long = items.select(item, gene).distinct().join(vectors, gene).select(item, F.posexplode(vector).alias("at", "v"))
    best = long.groupBy(item, "at").agg(F.max("v").alias("v"))
    return best.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(vector))


def class_loci(claims: DataFrame, group: str, locus: str, classes: list[str], skip: list[str]) -> DataFrame:
    """Claims of each locus of some classes; loci that are no name (`skip`, in lower case) are left out."""
    t = claims.where(F.col(group).isin(classes)).withColumn(locus, F.trim(F.coalesce(F.col(locus), F.lit(""))))
    return t.where(~F.lower(locus).isin(skip)).groupBy(group, locus).agg(F.count("*").alias("weight"))
