"""Workbooks (.xlsx) as a Spark data source and sink, and cohort claims from their sheets.

``spark.read.format("workbook").load(path)`` gives (path, sheet, row_idx, cells): one partition a sheet, whose rows are parsed
as the zip entry is read. path is a file, a folder, or a local pattern, on any store that pyarrow.fs reaches. row_idx is the
sheet's own number of the row (from 1); rows without cells are left out. cells are texts as Python shows the values (12, 0.001,
True), formulas by their stored result, an empty cell is null. A task holds the workbook's shared strings. What isn't a
workbook is an error; a workbook without sheets or a sheet without rows gives no rows.

The sink takes rows (workbook, sheet, cells) in order and writes a file for each workbook; null cells make an empty row.
"""

from __future__ import annotations

import glob
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from veristrata.functions import columns as K
from veristrata.operators import decoy, registry
from veristrata.sources.claims import claim_rows, expand_genes

ROWS = "path string, sheet string, row_idx long, cells array<string>"
#: Rows of a sheet at most, by the file format.
MOST_ROWS = 1 << 20
_BATCH = 2000
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The workbooks that a path names, in order."""
    if any(c in path for c in "*?["):
        return sorted(glob.glob(path.removeprefix("file://")))
    at, own = _store(path)
    info = at.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = [f.path for f in at.get_file_info(fs.FileSelector(own)) if f.type == fs.FileType.File and f.base_name.endswith(".xlsx") and f.base_name[0] not in "._"]
    return sorted(path.rstrip("/") + "/" + f.rsplit("/", 1)[-1] for f in found)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, entry) of the sheets in order."""
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    # a sheet has its own attribute sheetId beside the link's id, which has a namespace
    named = [(e.get("name"), links[next(v for k, v in e.attrib.items() if k.endswith("}id"))]) for e in book.iter() if _local(e.tag) == "sheet"]
    return [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in named if "chartsheet" not in target]


def _text_of(el: ElementTree.Element) -> str:
    """All runs of a string, without phonetic hints."""
    if _local(el.tag) == "rPh":
        return ""
    return (el.text or "" if _local(el.tag) == "t" else "") + "".join(_text_of(x) for x in el)


def _elements(stream, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; what has been read is let go."""
    root = None
    for event, el in ElementTree.iterparse(stream, events=("start", "end")):
        if root is None:
            root = el
        if event == "end" and _local(el.tag) == name:
            yield el
            el.clear()
            for parent in list(root):  # the rows' parent keeps them otherwise
                if _local(parent.tag) == "sheetData":
                    parent.clear()
            if _local(root.tag) == "sst":
                root.clear()


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_text_of(x) for x in cell if _local(x.tag) == "is"), None)
    v = next((x.text for x in cell if _local(x.tag) == "v"), None)
    if v is None:
        return None
    if kind == "s":
        return strings[int(v)]
    if kind == "b":
        return str(v.strip() == "1")
    if kind == "n":
        return str(float(v)) if any(c in v for c in ".eE") else str(int(v))
    return v


def sheet_rows(z: zipfile.ZipFile, entry: str) -> Iterator[tuple[int, list[str | None]]]:
    strings: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            strings = [_text_of(el) for el in _elements(f, "si")]
    last = 0
    with z.open(entry) as f:
        for row in _elements(f, "row"):
            last = int(row.get("r", last + 1))
            cells: list[str | None] = []
            for c in row:
                if _local(c.tag) == "c":
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(c, strings)
            if cells:
                yield last, cells


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str, entry: str):
        self.path, self.sheet, self.entry = path, sheet, entry


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str] | None):
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            at, own = _store(path)
            with at.open_input_file(own) as f, zipfile.ZipFile(f) as z:
                out += [_Sheet(path, name, entry) for name, entry in _sheets(z) if self.names is None or name in self.names]
        return out or [_Sheet("", "", "")]

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        at, own = _store(partition.path)
        with at.open_input_file(own) as f, zipfile.ZipFile(f) as z:
            idx, rows = [], []

            def batch():
                n = len(idx)
                values = [pa.array([partition.path] * n, pa.string()), pa.array([partition.sheet] * n, pa.string()), pa.array(idx, pa.int64()), pa.array(rows, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays(values, ["path", "sheet", "row_idx", "cells"])

            for i, cells in sheet_rows(z, partition.entry):
                idx.append(i)
                rows.append(cells)
                if len(idx) == _BATCH:
                    yield batch()
                    idx, rows = [], []
            if idx:
                yield batch()


class _Written(WriterCommitMessage):
    pass


class BookWriter:
    """One workbook, written as its rows come."""

    def __init__(self, sink):
        self.z, self.sheets, self.out, self.n = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED), [], None, 0

    def _end(self) -> None:
        if self.out:
            self.out.write(b"</sheetData></worksheet>")
            self.out.close()

    def row(self, sheet: str, cells: list[str | None] | None) -> None:
        if not self.sheets or self.sheets[-1] != sheet:
            if sheet in self.sheets:
                raise ValueError(f"the rows of sheet {sheet} are not together")
            self._end()
            self.sheets.append(sheet)
            self.out, self.n = self.z.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True), 0
            self.out.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
        self.n += 1
        if self.n > MOST_ROWS:
            raise ValueError(f"a sheet has no more than {MOST_ROWS} rows")
        made = []
        for v in cells or []:
            if v is None:
                made.append("<c/>")
            elif _NUMBER.fullmatch(v):
                made.append(f"<c><v>{v}</v></c>")
            else:
                made.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
        if made:
            self.out.write(f'<row r="{self.n}">{"".join(made)}</row>'.encode())

    def close(self) -> None:
        self._end()
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        numbers = range(1, len(self.sheets) + 1)
        self.z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers) + "</Types>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        self.z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        named = "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, s in zip(numbers, self.sheets, strict=True))
        self.z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{named}</sheets></workbook>')
        self.z.close()


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        at, own = _store(self.path)
        at.create_dir(own, recursive=True)
        book, name, sink = None, None, None

        def close():
            book.close()
            sink.close()
            at.move(f"{own}/_{name}.part", f"{own}/{name}.xlsx")  # under its name only when it is whole

        for b in batches:
            for r in b.to_pylist():
                if r["workbook"] != name:
                    if book:
                        close()
                    name = r["workbook"]
                    sink = at.open_output_stream(f"{own}/_{name}.part")
                    book = BookWriter(sink)
                book.row(r["sheet"], r["cells"])
        if book:
            close()
        return _Written()


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        names = self.options.get("sheets")
        return _Reader(self.options["path"], json.loads(names) if names else None)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def read_workbooks(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """(path, sheet, row_idx, cells) of all or the named sheets."""
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook")
    return (reader.option("sheets", json.dumps(sheets)) if sheets is not None else reader).load(path)


def write_workbooks(rows: DataFrame, path: str, order: list) -> None:
    """rows: (workbook, sheet, cells), and the columns of `order`; a workbook's sheets and rows come in that order."""
    rows.sparkSession.dataSource.register(WorkbookSource)
    rows.repartition("workbook").sortWithinPartitions("workbook", *order).select("workbook", "sheet", "cells").write.format("workbook").mode("append").save(path)


# ---- sheets with headers --------------------------------------------------------------------------------------------


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _holds(needle: str):
    return lambda c: c.contains(needle)


def headed(rows: DataFrame, sheet: str, needles: list[str] | None = None) -> DataFrame:
    """The rows of a sheet below its header, with it (`header`, in lower case): the first row of the sheet, or the first in which every needle
    is in some cell. Workbooks without the sheet, or without such a row, have no rows."""
    own = rows.where(F.col("sheet") == sheet)
    hit = F.lit(True)
    for n in needles or []:
        hit = hit & F.exists(F.transform("cells", _low), _holds(n.lower()))
    head = own.where(hit).groupBy("path").agg(F.min("row_idx").alias("_at"), F.min_by("cells", "row_idx").alias("_head"))
    return own.join(head, "path").where(F.col("row_idx") > F.col("_at")).withColumn("header", F.transform("_head", _low)).drop("_at", "_head")


def cell(at: int) -> Column:
    return F.get("cells", F.lit(at))


def named_cell(name: str, part: bool = False) -> Column:
    """The cell under a header that is `name`, or (part) the first that contains it; null without such a header."""
    at = F.array_position(F.transform("header", _holds(name.lower())), F.lit(True)) if part else F.array_position("header", F.lit(name.lower()))
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def _given(c: Column) -> Column:
    """What counts as a value: not empty, not nought."""
    return F.coalesce(~c.isin("", "0", "0.0", "False"), F.lit(False))


_ANNOTATION = r"\([^)]*\)"


def sheet_q_values(rows: DataFrame, sheet: str = "S26") -> DataFrame:
    """H4: (path, peptide, q, targets, decoys): the lowest q of each peptide, annotations in parentheses left out, in any order of columns."""
    t = headed(rows, sheet).where(_given(cell(0)))
    label = _low(named_cell("target_decoy"))
    t = t.select("path", F.upper(F.trim(F.regexp_replace(F.coalesce(named_cell("sequence"), F.lit("")), _ANNOTATION, ""))).alias("peptide"), named_cell("q-value").try_cast("double").alias("q"), (label == "decoy").alias("is_decoy"))
    key = F.struct("path", "peptide").alias("key")
    return decoy.best_q(t.where("peptide <> ''").select(key, "q", "is_decoy"), "key").select("key.*", "q", "targets", "decoys")


def gene_workbook_claims(rows: DataFrame, reactive: list[str], negative: list[str], citation: str, cancer: str, source: str) -> DataFrame:
    """Claims of workbooks with a sheet of genes and their peptides (S23), tested peptides (S16), types of genes (S19; the first row of a
    name counts) and q-values of peptides (S26)."""
    q = sheet_q_values(rows)
    body = headed(rows, "S23").where(_given(cell(0))).select("path", "row_idx", F.when(_given(cell(2)), cell(2)).otherwise(cell(0)).alias("gene"), cell(3).alias("biotype"), cell(7).alias("cell"))
    common = {"cancer_type": cancer, "citation_doi_pmid": citation}
    # a peptide's q belongs to its workbook: both travel as one key
    genes = expand_genes(body.withColumn("_row", F.concat_ws("#", "path", "row_idx")), common | {"citation_location": "Table S23"}, source)
    genes = genes.withColumn("path", F.substring_index("_source_row", "#", 1)).join(q.select("path", F.col("peptide").alias("peptide_sequence"), F.col("q").cast("string").alias("_q")), ["path", "peptide_sequence"], "left")
    genes = genes.withColumn("psm_qvalue", F.coalesce("_q", "psm_qvalue")).drop("_q")
    types = headed(rows, "S19").where(_given(cell(2)) & _given(cell(3))).groupBy("path", cell(2).alias("gene")).agg(F.min_by(cell(3), "row_idx").alias("biotype"))
    t = headed(rows, "S16").where(_given(cell(0))).select("path", F.upper(F.trim(cell(0))).alias("peptide"), cell(2).alias("gene"), _low(cell(9)).alias("specific"), F.upper(F.trim(F.coalesce(cell(11), F.lit("")))).alias("riborf"))
    t = t.join(types, ["path", "gene"], "left").join(q.select("path", "peptide", "q"), ["path", "peptide"], "left")
    spoken = F.col("specific").isin("yes", "no")
    tested = claim_rows(t, common | {
        "peptide_sequence": F.col("peptide"), "orf_id_or_locus": F.col("gene"), "orf_class": K.class_of_biotype(F.col("biotype")), "antigen_type": "TSA", "hla_allele": "HLA-A*02:01",
        "evidence_types": F.concat(F.when(F.col("riborf") == "YES", "Ribo-seq, ").otherwise(""), F.lit("immunopeptidomics, MHC binding assay, ELISPOT")), "ligand_len": F.length("peptide"), "psm_qvalue": F.col("q"),
        "tumor_specificity_modality": F.when(spoken, "normal-rna-matched"), "tumor_specificity_scope": F.when(spoken, "per-claim-reported"),
        "tumor_specificity_result": F.when(F.col("specific") == "yes", "absent-from-normal").when(F.col("specific") == "no", "detected-in-normal"),
        "validation_level": F.when(F.col("peptide").isin(reactive), "in-vivo").when(F.col("peptide").isin(negative), "validated_negative").otherwise("MS-presented"), "citation_location": "Tables S16/S17/S18",
    }, source, ["path"]).withColumn("_canonical", F.lit("no"))
    return genes.unionByName(tested, allowMissingColumns=True)


def unattached_q_values(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """(path, peptide) that have a q-value which no claim of their workbook carries."""
    key = F.struct("path", F.col("peptide")).alias("key")
    attached = claims.where(K.reported(F.col("psm_qvalue"))).select(F.struct("path", F.col("peptide_sequence").alias("peptide")).alias("key"))
    return registry.unattached(sheet_q_values(rows).select(key), attached, "key").select("key.*")


def candidate_workbook_claims(rows: DataFrame, citation: str, cancer: str, source: str, found: str = "Supplementary Table S2", tested: str = "Supplementary Table S3") -> DataFrame:
    """Claims of workbooks with a sheet of tested candidates, whose header is found by what it must say, and a sheet of all peptides.
    J15: candidates take the biotype of the last row of all peptides; J16: peptides that are candidates are not claimed again."""
    t = headed(rows, found).withColumn("raw", named_cell("peptide")).where(_given(F.col("raw")))
    every = t.select("path", "row_idx", F.upper(F.trim("raw")).alias("peptide"), named_cell("biotype").alias("biotype"), named_cell("gen_location").alias("location"), named_cell("gene symbol").alias("gene"))
    last = every.groupBy("path", "peptide").agg(F.max_by(F.struct("biotype", "location"), "row_idx").alias("b")).select("path", "peptide", "b.*")
    c = headed(rows, tested, ["sequence", "predicted hla", "gene symbol"]).withColumn("raw", named_cell("sequence", True)).where(_given(F.col("raw")))
    c = c.select("path", F.upper(F.trim("raw")).alias("peptide"), named_cell("gene symbol", True).alias("gene"), named_cell("predicted hla", True).alias("hla")).where(F.col("peptide").rlike(r"^\p{L}+$"))
    common = {"antigen_type": "TSA", "cancer_type": cancer, "citation_doi_pmid": citation, "peptide_sequence": F.col("peptide"), "orf_id_or_locus": F.col("gene"), "orf_class": K.class_of_biotype(F.col("biotype"), F.col("location")), "ligand_len": F.length("peptide")}
    candidates = claim_rows(c.join(last, ["path", "peptide"], "left"), common | {
        "hla_allele": F.col("hla"), "evidence_types": "immunopeptidomics, T-cell assay (result figure-locked)", "tumor_specificity_modality": "normal-ligandome-broad", "tumor_specificity_scope": "cohort-inclusion-criterion",
        "tumor_specificity_result": "absent-from-normal", "citation_location": "Table S3 + Fig 6",
    }, source, ["path"])
    rest = every.join(c.select("path", "peptide").distinct(), ["path", "peptide"], "left_anti")
    claimed = claim_rows(rest, common | {"evidence_types": "immunopeptidomics", "validation_level": "MS-presented", "citation_location": "Table S2"}, source, ["path"])
    return candidates.unionByName(claimed).withColumn("_canonical", F.lit("no"))


#: Peptides whose assays the gene cohort reports, reactive and not.
REACTIVE, NEGATIVE = ["WMSLDWELYV", "GLFHIYHKI"], ["HLWHSATSL", "FLTLQVHGA"]
