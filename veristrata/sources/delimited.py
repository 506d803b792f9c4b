"""Delimited text with quoted line breaks, read in as many tasks as there are splits.

Whether a split begins inside quotes depends on all before it, so a first pass runs over every split for both answers: of each
split it keeps where it would end if it began outside quotes, and if it began inside. These are maps of one bit; their
composition along a file (a prefix scan over one short row a split) fixes every split's true start. The second pass cuts
records at the line feeds that stand outside quotes. Parts of records that cross splits are put together by themselves.

Records are those of Python's ``csv`` (doubled quotes, a quote within a bare field is a character, ``\\r``, ``\\n`` and ``\\r\\n``
end a record outside quotes, empty records are skipped), fields of any length. (file, split, place) is the order of records in
their files, and of files by their paths. Bytes that are not UTF-8 become U+FFFD. Empty files have no records.
"""

from __future__ import annotations

import csv
import io
import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_MARK = "\x1eend\x1e"


def steady_session(spark: SparkSession) -> SparkSession:
    """A session in which a file is cut into the same splits each time, however many executors there are meanwhile."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            own.conf.set(k, v)
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        own.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return own


LINE = "struct<file: string, split: bigint, place: bigint>"


def numbered_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(_row_idx, value): lines; _row_idx (file, split, place) orders them within and between files, whatever the sizes of files and splits."""
    reader = steady_session(spark).read
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    place = F.monotonically_increasing_id()  # rises within a split
    return reader.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), place.alias("place")).alias("_row_idx"), "value")


def _rows(text: str, sep: str) -> list[list[str]]:
    """Records of text that begins outside quotes; an open quote at the end ends there."""
    csv.field_size_limit(sys.maxsize)
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether the place after the line and its line feed is inside quotes."""
    if '"' not in line:
        return inside
    csv.field_size_limit(sys.maxsize)
    pieces = list(io.StringIO(('"' if inside else "") + line + "\n", newline=""))
    last = []
    for last in csv.reader([*pieces, _MARK], delimiter=sep):
        pass
    return last != [_MARK]


def _runs(batches):
    """(file, split, lines as an Arrow array) of runs of one split within a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column("file")
        file, split = names.dictionary_encode().indices.to_numpy(zero_copy_only=False), b.column("split").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(split) != 0)) + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield names[int(i)].as_py(), int(split[i]), b.column("value").slice(int(i), int(j - i))


def _quoted(lines: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))


def _ends(sep: str):
    """First pass: where each split ends, for both starts, and the first record of a file if it lies within the file's first split."""

    def run(batches):
        at, state, begun, head = None, None, None, None

        def row():
            values = [pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int64()), pa.array([state[0]]), pa.array([state[1]]), pa.array([head], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(values, ["file", "split", "if_outside", "if_inside", "head"])

        for file, split, lines in _runs(batches):
            if (file, split) != at:
                if at is not None:
                    yield row()
                at, state, head = (file, split), [False, True], None
                begun = [] if split == 0 else None
            done = 0
            while begun is not None and done < len(lines):
                line, done = lines[done].as_py(), done + 1
                state = [ends_inside(line, x, sep) for x in state]
                begun.append(line)
                if not state[0]:
                    rows = _rows("\n".join(begun), sep)
                    head, begun = (rows[0], None) if rows else (None, [])
            for k in _quoted(lines.slice(done)) + done:
                line = lines[int(k)].as_py()
                same = state[0] == state[1]
                state[0] = ends_inside(line, state[0], sep)
                state[1] = state[0] if same else ends_inside(line, state[1], sep)
        if at is not None:
            yield row()

    return run


class Starts:
    """Which splits begin inside quotes."""

    def __init__(self, inside: set[tuple[str, int]], step: int):
        self.inside, self.step = inside, step

    def __call__(self, file: str, split: int) -> bool:
        if split % self.step if self.step else split:
            raise RuntimeError("the splits of a file have changed between two passes over it")
        return (file, split) in self.inside


RECORD = "file string, split long, place long, fields array<string>"


def _batch(file: str, split: int, place: int, fields: pa.Array) -> pa.RecordBatch:
    n = len(fields)
    return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.full(n, split)), pa.array(np.arange(place, place + n)), fields.cast(pa.list_(pa.string()))], ["file", "split", "place", "fields"])


def _whole_records(starts: Starts, sep: str):
    """Second pass: the records that lie within a split."""

    def run(batches):
        at, inside, head, begun, place = None, False, False, [], 0
        for file, split, lines in _runs(batches):
            if (file, split) != at:
                at, begun, place = (file, split), [], 0
                inside = head = starts(file, split)  # head: still in the record that an earlier split began
            quoted = _quoted(lines)
            if not len(quoted) and not inside and not pc.any(pc.match_substring(lines, "\r")).as_py():
                bare = lines.filter(pc.greater(pc.binary_length(lines), 0))
                if len(bare):
                    yield _batch(file, split, place, pc.split_pattern(bare, sep))
                    place += len(bare)
                continue
            marks, whole = set(quoted.tolist()), []
            for k, line in enumerate(lines.to_pylist()):
                if k in marks:
                    inside = ends_inside(line, inside, sep)
                if head:
                    head = inside
                    continue
                begun.append(line)
                if not inside:
                    whole += begun
                    begun = []
            rows = _rows("\n".join(whole), sep)
            if rows:
                yield _batch(file, split, place, pa.array(rows, pa.list_(pa.string())))
                place += len(rows)

    return run


def _broken_records(starts: Starts, sep: str):
    """Of splits at whose start or end a record is open: the text up to the first end of a record (kind 0), and that after the last (kind 1).
    A split without any such end, inside one record from its start to its end, is all of kind 0."""

    def run(batches):
        at, inside, head, text, place = None, False, False, [], 0

        def row(kind):
            values = [pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int64()), pa.array([kind], pa.int32()), pa.array([place], pa.int64()), pa.array(["\n".join(text)], pa.string())]
            return pa.RecordBatch.from_arrays(values, ["file", "split", "kind", "place", "text"])

        for file, split, lines in _runs(batches):
            if (file, split) != at:
                if at is not None and text:
                    yield row(0 if head else 1)
                at, text, place = (file, split), [], 0
                inside = head = starts(file, split)
            for line in lines.to_pylist():
                inside = ends_inside(line, inside, sep)
                text.append(line)
                if not inside:
                    if head:
                        yield row(0)
                    else:
                        place += len(_rows("\n".join(text), sep))
                    head, text = False, []
        if at is not None and text:
            yield row(0 if head else 1)

    return run


def _read_whole(sep: str):
    def run(batches):
        for b in batches:
            for file, split, place, text in zip(*(b.column(c).to_pylist() for c in ("file", "split", "place", "text")), strict=True):
                rows = _rows(text, sep)
                if rows:
                    yield _batch(file, split, place, pa.array(rows, pa.list_(pa.string())))

    return run


class Delimited:
    """Files with the true starts of all their splits.

    What the driver keeps: a bit for the splits that begin or end inside quotes, and the different headers; both are less than
    its own list of splits.
    """

    def __init__(self, spark: SparkSession, path: str, sep: str = ","):
        self.sep, self.path = sep, path
        self.lines = steady_session(spark).read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.make_valid_utf8("value").alias("value"))
        ends = self.lines.mapInArrow(_ends(sep), "file string, split long, if_outside boolean, if_inside boolean, head array<string>")
        # a split's map is a constant, or the bit as it was, or the bit turned: since the last constant only turns count
        w = Window.partitionBy("file").orderBy("split")
        turns = F.sum((F.col("if_outside") & ~F.col("if_inside")).cast("long")).over(w)
        constant = F.when(F.col("if_outside") == F.col("if_inside"), F.col("turns") + F.col("if_outside").cast("long"))
        scanned = ends.withColumn("turns", turns).withColumn("since", F.last(constant, ignorenulls=True).over(w))
        after = scanned.withColumn("after", (F.col("turns") + F.coalesce("since", F.lit(0))) % 2 == 1)
        known = after.withColumn("inside", F.coalesce(F.lag("after").over(w), F.lit(False)))
        got = known.agg(
            F.collect_list(F.when(F.col("inside") | F.col("after"), F.struct("file", "split", "inside"))).alias("broken"), F.collect_set(F.when(F.col("split") > 0, F.col("split"))).alias("at"),
            F.collect_set("head").alias("heads"), F.count_distinct("file").alias("files"), F.count("head").alias("begun"),
        ).head()
        self.broken = [(r["file"], r["split"]) for r in got["broken"]]
        self.starts = Starts({(r["file"], r["split"]) for r in got["broken"] if r["inside"]}, math.gcd(*got["at"]) if got["at"] else 0)
        #: The header of all files, if they have the same; None if they differ, or one isn't within its file's first split.
        self.header = list(got["heads"][0]) if len(got["heads"]) == 1 and got["files"] == got["begun"] else None

    def records(self) -> DataFrame:
        """(file, split, place, fields): every record, headers included; (file, split, place) is their order."""
        out = self.lines.mapInArrow(_whole_records(self.starts, self.sep), RECORD)
        if not self.broken:
            return out
        some = self.lines.sparkSession.createDataFrame(self.broken, "file string, split long")
        parts = self.lines.join(F.broadcast(some), ["file", "split"], "left_semi").mapInArrow(_broken_records(self.starts, self.sep), "file string, split long, kind int, place long, text string")
        of = F.sum("kind").over(Window.partitionBy("file").orderBy("split", "kind"))  # the open record that a part belongs to
        whole = parts.withColumn("of", of).groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("split", "kind", "place", "text"))).alias("p"))
        crossing = whole.select("file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["place"].alias("place"), F.array_join(F.col("p.text"), "\n").alias("text"))
        return out.unionAll(crossing.mapInArrow(_read_whole(self.sep), RECORD))

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """With _row_idx, a long in the order of (file, split, place): a split has fewer records than twice its bytes."""
        files = self.lines.sparkSession.read.format("binaryFile").load(self.path).select(F.col("_metadata.file_path").alias("file"), (2 * (F.col("length") + 1)).alias("room"))
        place = 2 * F.col("split") + F.col("place")
        if files.count() == 1:
            return rows.withColumn("_row_idx", place)
        before = F.sum("room").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        base = files.select("file", F.coalesce(before, F.lit(0)).alias("base"))  # a row a file, of which the driver has a list anyway
        return rows.join(F.broadcast(base), "file").withColumn("_row_idx", F.col("base") + place).drop("base")

    def table(self, columns: list[str] | None = None) -> DataFrame:
        """The columns by the names of the header (all of it, unless named), and _row_idx, a long in the order of the rows. A name that a file
        lacks, a field that a record lacks, and an empty field are null; of repeated names the last one counts; further fields are ignored."""
        rows = self._numbered(self.records())
        if self.header is not None:
            names = [n.lstrip("\ufeff") if i == 0 else n for i, n in enumerate(self.header)]
            at = {n: i for i, n in enumerate(names)}
            body = rows.where(~((F.col("split") == 0) & (F.col("place") == 0)))
            field = lambda c: F.get("fields", F.lit(at[c])) if c in at else F.lit(None).cast("string")
            columns = list(at) if columns is None else columns
        else:
            first = rows.groupBy("file").agg(F.min("_row_idx").alias("first"), F.min_by("fields", "_row_idx").alias("head"))
            body = rows.join(first, "file").where(F.col("_row_idx") > F.col("first")).withColumn("head", F.reverse(F.transform("head", lambda x: F.ltrim(x, F.lit("\ufeff")))))
            field = lambda c: F.when(F.array_contains("head", c), F.get("fields", (F.size("head") - F.array_position("head", F.lit(c))).cast("int")))
            if columns is None:
                columns = [r.c for r in first.select(F.explode("head").alias("c")).distinct().orderBy("c").collect()]  # names of columns
        return body.select("_row_idx", *[F.nullif(field(c), F.lit("")).alias(c) for c in columns])
