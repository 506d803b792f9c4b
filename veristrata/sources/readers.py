"""Scans (S1-S27). Every reader is lazy, has an explicit schema and drops only the rows its format says to drop."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veristrata import config as C
from veristrata.functions.columns import class_of_accession
from veristrata.sources import gzipped
from veristrata.sources.delimited import LINE, Delimited, numbered_lines
from veristrata.sources.gzipped import gzip_records


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def headered_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A file with a header; quotes are doubled, fields may hold line breaks and have any length. Columns by name, empty
    fields null. Splits of the file are read in parallel (sources.delimited)."""
    return Delimited(spark, path, sep).table(columns).drop("_row_idx")


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The names of the columns, for checks before a file is read."""
    return [c for c in Delimited(spark, path, sep).table().columns if c != "_row_idx"]


def claims_csv(spark: SparkSession, path: str) -> DataFrame:
    return headered_csv(spark, path, [*C.CLAIM_COLUMNS, *C.LINEAGE_COLUMNS])


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_row_idx, value): lines and their order; of gzip files by ranges of theirs."""
    if path.endswith(".gz"):
        return gzip_records(spark, [p for p, _ in listed(spark, path)], "\n", gzipped.SPAN).withColumn("value", F.rtrim("value", F.lit("\r")))
    return numbered_lines(spark, path)


def positional(spark: SparkSession, path: str, fields: int, min_fields: int = 1, sep: str = "\t", skip: int = 1) -> DataFrame:
    """(_row_idx, the order of lines, and) fields by place (_c0 ...); lines with fewer than min_fields go, as do the first `skip` lines of each file. A field
    in double quotes may hold the separator, and doubled quotes in it are one; a record is one line."""
    lines = ordered_lines(spark, path)
    if skip:  # the first lines of a file are the first of its first split
        first = lines.where("_row_idx.split = 0").groupBy(F.col("_row_idx.file").alias("_f")).agg(F.min("_row_idx.place").alias("_first"))
        early = (F.col("_row_idx.split") == 0) & (F.col("_row_idx.place") < F.col("_first") + skip)
        lines = lines.withColumn("_f", F.col("_row_idx.file")).join(first, "_f").where(~early)
    s = re.escape(sep)
    bare = F.split("value", s, -1)
    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(sep), F.col("value")), F.lit(rf'{s}("(?:[^"]|"")*"|[^{s}]*)'), 1), lambda x: F.when(x.rlike(r'(?s)^".*"$') & (F.length(x) > 1), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    parts = lines.select("_row_idx", F.when(F.col("value").contains('"'), quoted).otherwise(bare).alias("p")).where(F.size("p") >= min_fields)
    return parts.select("_row_idx", *[F.get("p", F.lit(i)).alias(f"_c{i}") for i in range(fields)])


def atlas_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq, length, orf_id, tissue): alphabetic sequences, upper-cased; length falls back to that of the sequence."""
    t = positional(spark, path, 4, min_fields=4)
    seq = F.upper(F.trim("_c0"))
    return t.where(seq.rlike(r"^\p{L}+$")).select("_row_idx", seq.alias("seq"), F.coalesce(F.trim("_c1").try_cast("double").try_cast("int"), F.length(seq)).alias("length"), F.trim("_c2").alias("orf_id"), F.trim("_c3").alias("tissue"))


def normal_ligands(spark: SparkSession, path: str, mhc_class: str = "HLA-I") -> DataFrame:
    """(seq, tissues)."""
    t = positional(spark, path, 5, min_fields=5).where(F.col("_c2").contains(mhc_class))
    return t.select(F.upper(F.trim("_c1")).alias("seq"), F.transform(F.split("_c4", ","), lambda x: F.trim(x)).alias("tissues"))


def fasta(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    """(protein_idx, header, acc, entry, gene, seq), upper-cased; species: an OX= number that headers must have."""
    if path.endswith(".gz"):  # ranges of the compressed files, a task each
        raw = gzip_records(spark, [p for p, _ in listed(spark, path)], "\n>", gzipped.SPAN)
    else:
        raw = spark.read.option("lineSep", "\n>").text(path)
    raw = raw.withColumn("protein_idx", F.monotonically_increasing_id())
    rec = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(rec, r"^([^\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace(rec, r"^[^\r\n]*", ""), r"[^A-Za-z]", ""))
    out = raw.select("protein_idx", head.alias("header"), seq.alias("seq")).where(F.col("seq") != "")
    if species:
        out = out.where(F.col("header").rlike(rf"\bOX={species}\b"))
    parts = F.split("header", r"\|")
    entry = F.substring_index(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), " ", 1)
    gene = F.nullif(F.regexp_extract("header", r"\bGN=(\S+)", 1), F.lit(""))
    return out.select("protein_idx", "header", F.coalesce(F.get(parts, F.lit(1)), F.substring_index("header", " ", 1)).alias("acc"), F.nullif(entry, F.lit("")).alias("entry"), gene.alias("gene"), "seq")


def pepxml(spark: SparkSession, path: str, decoy_prefix: str = "rev_", score: str = "hyperscore") -> DataFrame:
    """Hits of rank 1 with the named score; the decoy prefix marks and is stripped."""
    kind = "_hit_rank string, _peptide string, _protein string, search_score array<struct<_name:string,_value:string>>"
    hits = spark.read.format("xml").option("rowTag", "search_hit").option("valueTag", "_text").schema(kind).load(path).where("_hit_rank = '1'")
    value = F.try_element_at(F.filter("search_score", lambda s: s["_name"] == score), F.lit(1))["_value"].try_cast("double")
    return _psms(hits.select("_peptide", "_protein", value.alias("score")).where("score is not null"), F.col("_protein"), F.lit(False), decoy_prefix, F.col("_peptide"), F.col("score"), F.lit(None).cast("double"), F.monotonically_increasing_id())


def _psms(df: DataFrame, protein: Column, decoy: Column, prefix: str, peptide: Column, score: Column, q: Column, order: Column, ident: Column | None = None) -> DataFrame:
    by_prefix = protein.startswith(prefix) if prefix else F.lit(False)
    acc = F.when(by_prefix, F.substr(protein, F.lit(len(prefix) + 1))).otherwise(protein)
    out = df.select((ident if ident is not None else F.concat(F.lit("psm"), order)).alias("id"), peptide.alias("peptide"), score.alias("score"), q.alias("q"), (decoy | by_prefix).alias("is_decoy"), acc.alias("accession"), order.alias("_row_idx"))
    return out.withColumn("class", class_of_accession(F.col("accession")))


def psm_tsv(spark: SparkSession, path: str, ident: str = "PSMId", peptide: str = "peptide", protein: str = "Proteins", decoy: str | None = "is_decoy", score: str | None = None, q: str | None = None, decoy_prefix: str = "rev_") -> DataFrame:
    """Matches with caller-named columns, and _row_idx, their order; a decoy text of the truthy set or the prefix marks a decoy."""
    t = Delimited(spark, path, "\t").table()
    if missing := [c for c in (ident, peptide, protein, decoy, score, q) if c and c not in t.columns]:
        raise ValueError(f"columns not in the input: {', '.join(missing)}")
    number = lambda c: F.trim(f"`{c}`").try_cast("double") if c else F.lit(None).cast("double")
    is_decoy = F.lower(F.trim(F.coalesce(F.col(f"`{decoy}`"), F.lit("")))).isin(C.DECOY_TEXTS) if decoy else F.lit(False)
    return _psms(t, F.col(f"`{protein}`"), is_decoy, decoy_prefix, F.col(f"`{peptide}`"), number(score), number(q), F.col("_row_idx"), F.col(f"`{ident}`"))


def expression_gct(spark: SparkSession, path: str, by_ensembl: bool = False) -> DataFrame:
    """(gene, vector) of a GCT file: by symbol, duplicates merged by element-wise maximum; or by id without version, the
    last row wins."""
    t = ordered_lines(spark, path).select("_row_idx", F.split("value", "\t").alias("p"))
    rows = t.where((F.size("p") > 2) & (F.get("p", F.lit(0)) != "Name"))
    vector = F.transform(F.slice("p", 3, 1_000_000), lambda x: x.try_cast("double"))
    if by_ensembl:
        one = rows.select(F.substring_index(F.get("p", F.lit(0)), ".", 1).alias("gene"), vector.alias("vector"), "_row_idx")
        return one.groupBy("gene").agg(F.max_by("vector", "_row_idx").alias("vector"))
    long = rows.select(F.get("p", F.lit(1)).alias("gene"), F.posexplode(vector).alias("at", "v")).groupBy("gene", "at").agg(F.max("v").alias("v"))
    return long.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("vector"))


def gtf(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """(gene_id, transcript_id, gene_name, _row_idx), ids without version; a path that isn't there is an empty table."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], f"gene_id string, transcript_id string, gene_name string, _row_idx {LINE}")
    t = ordered_lines(spark, path).select("_row_idx", F.split("value", "\t").alias("p")).where(F.get("p", F.lit(2)) == feature)
    got = lambda k: F.nullif(F.substring_index(F.regexp_extract(F.get("p", F.lit(8)), k + r' "([^"]*)"', 1), "." if k != "gene_name" else "\t", 1), F.lit(""))
    return t.select(got("gene_id").alias("gene_id"), got("transcript_id").alias("transcript_id"), got("gene_name").alias("gene_name"), "_row_idx")


def transcript_genes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(transcript_id, gene_id), the last row of each transcript, and (gene_name, gene_id), the first row of each name."""
    t = gtf(spark, path, "transcript")
    last = t.where("transcript_id is not null").groupBy("transcript_id").agg(F.max_by("gene_id", "_row_idx").alias("gene_id"))
    return last, t.where("gene_name is not null").groupBy("gene_name").agg(F.min_by("gene_id", "_row_idx").alias("gene_id"))


def gene_names(spark: SparkSession, path: str) -> DataFrame:
    """(gene_name, gene_id) of gene rows, the last of each name."""
    return gtf(spark, path, "gene").where("gene_name is not null").groupBy("gene_name").agg(F.max_by("gene_id", "_row_idx").alias("gene_id"))


def gene_info(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, kind, name, _row_idx): symbols, synonyms and Ensembl cross references, each once, with its last row."""
    t = positional(spark, path, 6, min_fields=6)
    row = lambda kind, c: t.select(F.col("_c1").alias("gene_id"), F.lit(kind).alias("kind"), c.alias("name"), "_row_idx")
    many = lambda i: F.explode(F.split(f"_c{i}", r"\|"))
    xref = row("xref", many(5)).where(F.col("name").startswith("Ensembl:")).withColumn("name", F.substring_index(F.regexp_replace("name", "^Ensembl:", ""), ".", 1))
    return row("symbol", F.col("_c2")).unionAll(row("synonym", many(4))).unionAll(xref).where("name <> '-'").groupBy("gene_id", "kind", "name").agg(F.max("_row_idx").alias("_row_idx"))


def gene_group(spark: SparkSession, path: str, relation: str = "Related functional gene", reverse: str = "Related pseudogene") -> DataFrame:
    """(a, b) of a relation and its reverse, in one direction."""
    t = positional(spark, path, 5, min_fields=5)
    return t.where(F.col("_c2") == relation).select(F.col("_c1").alias("a"), F.col("_c4").alias("b")).unionByName(t.where(F.col("_c2") == reverse).select(F.col("_c4").alias("a"), F.col("_c1").alias("b"))).distinct()


def hgnc(spark: SparkSession, path: str) -> DataFrame:
    """(name, gene_id, kind): current symbols before previous ones before aliases; the first wins."""
    t = headered_csv(spark, path, ["entrez_id", "symbol", "prev_symbol", "alias_symbol", "gene_group"], sep="\t").where("entrez_id is not null")
    part = lambda rank, c: t.select(F.explode(F.split(c, r"\|")).alias("name"), F.col("entrez_id").alias("gene_id"), F.lit(rank).alias("kind"))
    every = part(0, "symbol").unionAll(part(1, "prev_symbol")).unionAll(part(2, "alias_symbol")).where("name <> ''")
    return every.groupBy("name").agg(F.min(F.struct("kind", "gene_id")).alias("s")).select("name", "s.gene_id", "s.kind")


def abundance(spark: SparkSession, path: str) -> DataFrame:
    """(protein, ppm): the field with ENSP, the last field as a number above 0, the most of duplicates; no rows at all is an error."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.try_element_at(F.filter(p, lambda x: F.upper(x).contains("ENSP")), F.lit(1)).alias("protein"), F.try_element_at(p, F.lit(-1)).try_cast("double").alias("ppm"))
    out = rows.where("protein is not null and ppm > 0").groupBy("protein").agg(F.max("ppm").alias("ppm"))
    if out.isEmpty():
        raise ValueError(f"no abundances in {path}")
    return out


def id_links(spark: SparkSession, path: str, taxon: str = "9606.") -> DataFrame:
    """(protein, entry) of a taxon."""
    p = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.col("value").startswith(taxon)).select(F.get(p, F.lit(0)).alias("protein"), F.get(p, F.lit(1)).alias("entry"))


def sheet(rows: DataFrame, needles: list[str]) -> DataFrame:
    """An exported sheet (_row_idx, cells array) with its header found: the first row where each needle is in some cell. Gives
    (_row_idx, cells, header); spreadsheets themselves are exported before, no reader for them is installed."""
    def some_cell(needle: str) -> Column:
        return F.exists("cells", lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(needle.lower()))

    hit = F.lit(True)
    for n in needles:
        hit = hit & some_cell(n)
    head = rows.where(hit).agg(F.min("_row_idx").alias("_h"), F.min_by("cells", "_row_idx").alias("header"))
    return rows.crossJoin(F.broadcast(head)).where(F.col("_row_idx") > F.col("_h")).drop("_h")  # one row


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def resolve(base: str | None, name: str, variable: str = "VERISTRATA_DATA") -> str:
    """A path below the given base, or the folder that the environment names; it must exist if it is local."""
    path = f"{base or os.environ.get(variable, '.')}/{name}"
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


#: Bytes of a file that are in memory while its digest is made.
CHUNK = 8 << 20


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of the files that a path, a pattern or a folder names, empty ones too; names that begin with . or _ are left out."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = list(fs.globStatus(at) or [])
    files = [f for x in own for f in (fs.listStatus(x.getPath()) if x.isDirectory() else [x]) if not f.isDirectory()]
    return sorted((f.getPath().toString(), f.getLen()) for f in files if f.getPath().getName()[0] not in "._")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files of any length, on any store that pyarrow.fs reaches: a task streams a file's chunks through the
    state of the hash."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            out = []
            for p in b.column("path").to_pylist():
                at, own = fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p.removeprefix("file:"))
                h = hashlib.sha256()
                with at.open_input_stream(own) as f:
                    while chunk := f.read(CHUNK):
                        h.update(chunk)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(out, pa.string())], ["path", "length", "sha256"])

    files = listed(spark, path)
    if not files:
        raise FileNotFoundError(path)
    parts = min(len(files), spark.sparkContext.defaultParallelism * 4)
    return spark.createDataFrame(files, "path string, length long").repartition(parts, "path").mapInArrow(run, "path string, length long, sha256 string")


def json_artifact(spark: SparkSession, path: str) -> DataFrame:
    """S26."""
    return spark.read.json(path, multiLine=True)


def class_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(pattern, class) in order, comments left out; a file of rules, not of data."""
    rows = ordered_lines(spark, path).where(~F.col("value").startswith("#") & F.col("value").contains("\t")).orderBy("_row_idx").collect()
    return [(a.strip(), b.strip()) for a, b in (r.value.split("\t")[:2] for r in rows)]
