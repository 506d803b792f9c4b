"""Gzip files by ranges, against Python's gzip."""

import gzip
import random

import pytest

from veristrata.sources import gzipped, readers


def text(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\n>", " é "]) for _ in range(n))


@pytest.mark.parametrize("sep", ["\n", "\n>"])
def test_ranges_hold_each_record_once(spark, tmp_path, sep):
    rng = random.Random(1)
    bodies = [text(rng, 400_000), "", "no end of line", text(rng, 200_000) + "\n"]
    data = [gzip.compress(t.encode(), level) for t, level in zip(bodies, (6, 6, 9, 1), strict=True)]
    members = [text(rng, 30_000) for _ in range(6)]
    data.append(b"".join(gzip.compress(t.encode()) for t in members) + bytes(100))
    bodies.append("".join(members))
    paths = []
    for i, x in enumerate(data):
        (tmp_path / f"{i}.gz").write_bytes(x)
        paths.append(f"{tmp_path}/{i}.gz")
    points = [gzipped.access_points(p, 150_000)[0] for p in paths]
    assert len(points[0]) > 3 and any(p[0] % 8 for p in points[0]) and len(points[4]) >= 2
    for p, own, t in zip(paths, points, bodies, strict=True):
        for bit, out, window, member in own:
            assert b"".join(gzipped._output(p, bit, window, member)) == t.encode()[out:]
    got = gzipped.gzip_records(spark, paths, sep, 150_000)
    assert got.rdd.getNumPartitions() >= sum(map(len, points)) - 3
    rows = [(r._row_idx.file, r._row_idx.split, r._row_idx.place, r.value) for r in got.collect()]
    for p, t in zip(paths, bodies, strict=True):
        want = t.split(sep)
        assert [v for f, _, _, v in sorted(rows) if f == p] == (want if want[-1] else want[:-1])


def test_a_damaged_file_is_an_error(tmp_path):
    whole = gzip.compress(text(random.Random(2), 100_000).encode())
    (tmp_path / "a.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(EOFError):
        gzipped.access_points(f"{tmp_path}/a.gz")


def test_compressed_sequences_by_species(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(f"P{i}", rng.choice(["9606", "960", "10090"]), "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randrange(50, 900)))) for i in range(1500)]
    lines = "".join(f">sp|{a}|{a}_X Protein OX={ox} GN=G{a}\n" + "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + "\n" for a, ox, s in rows)
    (tmp_path / "s.fasta.gz").write_bytes(gzip.compress(lines.encode()))
    monkeypatch.setattr(gzipped, "SPAN", 100_000)
    t = readers.fasta(spark, f"{tmp_path}/s.fasta.gz", "9606")
    assert {(r.acc, r.gene, r.seq) for r in t.collect()} == {(a, f"G{a}", s) for a, ox, s in rows if ox == "9606"}


def test_tables_and_annotations_in_gzip(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    n = 6000
    table = "head\tx\n" + "".join(f"{i}\t{rng.randrange(10**9)}\r\n" for i in range(n))
    (tmp_path / "t.tsv.gz").write_bytes(gzip.compress(table.encode()))
    gct = "#1.2\nName\tDescription\ta\n" + "".join(f"ENSG{i % 700}.{i}\tS\t{rng.random()}\n" for i in range(n))
    (tmp_path / "g.gct.gz").write_bytes(gzip.compress(gct.encode()))
    monkeypatch.setattr(gzipped, "SPAN", 20_000)
    rows = readers.positional(spark, f"{tmp_path}/t.tsv.gz", 2, 2).orderBy("_row_idx").collect()
    assert [(r._c0, r._c1) for r in rows] == [tuple(x.strip().split("\t")) for x in table.split("\n")[1:-1]]
    want = {}
    for line in gct.split("\n")[2:-1]:
        name, _, v = line.split("\t")
        want[name.split(".")[0]] = float(v)
    assert {r.gene: r.vector[0] for r in readers.expression_gct(spark, f"{tmp_path}/g.gct.gz", by_ensembl=True).collect()} == want
