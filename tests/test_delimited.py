"""Delimited text in splits, against Python's csv."""

import csv
import random

import pytest

from veristrata.sources import delimited, readers


@pytest.fixture
def small_splits(spark):
    own = spark.newSession()
    for k, v in (("spark.sql.files.maxPartitionBytes", "2000"), ("spark.sql.files.openCostInBytes", "0"), ("spark.sql.files.minPartitionNum", "1")):
        own.conf.set(k, v)
    return own


def field(rng):
    kind = rng.random()
    if kind < 0.5:
        return "".join(rng.choice("abc é") for _ in range(rng.randrange(9)))
    inner = "".join(rng.choice(["a", "\n", "\n", '""', "\t", ",", "\r\n", "\r", "é", " "]) for _ in range(rng.randrange(12)))
    if kind < 0.9:
        return f'"{inner}"'
    return rng.choice(['x"y', 'a"', '"q"tail', '"q"t"', "' '", '""""'])


def written(path, rng, rows, width, sep, end="\n", bad_end=False):
    lines = [sep.join(f"c{i}" for i in range(width))] + [sep.join(field(rng) for _ in range(rng.choice([width, width, width - 1, width + 2]))) for _ in range(rows)]
    lines.insert(5, "")
    if rows > 50:
        lines.insert(20, sep.join(['"' + "long\n" * 3000 + '"', "after"]))  # over many splits
        lines.insert(40, sep.join(['"' + "no break " * 700 + '"', "after"]))
    text = end.join(lines) + ('\n"never closed\nx' if bad_end else "")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    with open(path, newline="", encoding="utf-8") as f:
        csv.field_size_limit(1 << 30)
        return [r for r in csv.reader(f, delimiter=sep) if r]


@pytest.mark.parametrize(("seed", "sep", "end"), [(1, ",", "\n"), (2, "\t", "\r\n"), (3, ",", "\r"), (4, "\t", "\n")])
def test_records_equal_csv(small_splits, tmp_path, seed, sep, end):
    rng = random.Random(seed)
    want = [r for i, n in enumerate([400, 3, 150]) for r in written(f"{tmp_path}/f{i}.csv", rng, n, 4, sep, end, bad_end=seed == 4)]
    d = delimited.Delimited(small_splits, str(tmp_path), sep)
    assert end == "\r" or (d.lines.rdd.getNumPartitions() > 5 and d.broken)
    got = [list(r.fields) for r in sorted(d.records().collect(), key=lambda r: (r.file, r.split, r.place))]
    assert got == want


def test_starts_by_both_hypotheses(small_splits, tmp_path):
    """A line feed that only the scan can tell: each split alone reads as either."""
    body = '"' + ('x,"",y\n' * 2000) + '",1\n' + "p,q\n" * 500 + '"' + ("z\n" * 3000) + '",2\n'
    (tmp_path / "a.csv").write_text("h,i\n" + body)
    rows = readers.headered_csv(small_splits, f"{tmp_path}/a.csv").collect()
    assert len(rows) == 502 and sum(r.h == 'x,",y\n' * 2000 for r in rows) == 1
    assert sum(r.i == "q" for r in rows) == 500 and [r.i for r in rows if r.h == "z\n" * 3000] == ["2"]


def test_tables_by_name(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,v,v\n1,a,b\n2,,\n\n3\n", encoding="utf-8")
    same = readers.headered_csv(small_splits, f"{tmp_path}/a.csv", ["v", "id", "none"])
    assert sorted((r.id, r.v, r.none) for r in same.collect()) == [("1", "b", None), ("2", None, None), ("3", None, None)]
    (tmp_path / "b.csv").write_text('v,"i\nd",id\nx,y,9\n')
    (tmp_path / "c.csv").write_text("")
    both = readers.headered_csv(small_splits, str(tmp_path))
    assert sorted(both.columns) == ["i\nd", "id", "v"]
    assert sorted((r.id, r.v, r["i\nd"]) for r in both.collect()) == [("1", "b", None), ("2", None, None), ("3", None, None), ("9", "x", "y")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("")
    assert readers.headered_csv(small_splits, f"{tmp_path}/empty", ["a"]).collect() == []


def test_a_joined_table_keeps_its_splits(spark, small_splits, tmp_path):
    rng = random.Random(9)
    want = written(f"{tmp_path}/a.csv", rng, 300, 3, ",")
    t = readers.headered_csv(small_splits, str(tmp_path), ["c0"])
    joined = spark.range(1).crossJoin(t.select("c0"))  # planned by a session with other splits
    assert sorted(r.c0 or "" for r in joined.collect()) == sorted(r[0] for r in want[1:])


def test_order_of_rows_over_files(spark, small_splits, tmp_path):
    """First and last hold over three files of unlike sizes, in the order of their paths."""
    line = lambda i, name: f'chr\tX\ttranscript\t1\t2\t.\t+\t.\tgene_id "G{i}.1"; transcript_id "T{i % 40}.2"; gene_name "N{name}";'
    sizes, want_last, want_first, i = [300, 1, 40], {}, {}, 0
    for f, n in enumerate(sizes):
        rows = []
        for _ in range(n):
            rows.append(line(i, i % 25))
            want_last[f"T{i % 40}"] = f"G{i}"
            want_first.setdefault(f"N{i % 25}", f"G{i}")
            i += 1
        (tmp_path / f"p{f}.gtf").write_text("\n".join(rows) + "\n")
    last, first = readers.transcript_genes(small_splits, str(tmp_path))
    assert {r.transcript_id: r.gene_id for r in last.collect()} == want_last
    assert {r.gene_name: r.gene_id for r in first.collect()} == want_first
    for f, n in enumerate(sizes):
        (tmp_path / f"q{f}.tsv").write_text("id\tv\n" + "".join(f"{f}-{k}\tx\n" for k in range(n)))
    t = delimited.Delimited(small_splits, f"{tmp_path}/q*.tsv", "\t").table(["id"])
    assert [r.id for r in t.orderBy("_row_idx").collect()] == [f"{f}-{k}" for f, n in enumerate(sizes) for k in range(n)]
    lines = readers.positional(small_splits, f"{tmp_path}/q*.tsv", 1)
    assert [r._c0 for r in lines.orderBy("_row_idx").collect()] == [f"{f}-{k}" for f, n in enumerate(sizes) for k in range(n)]
