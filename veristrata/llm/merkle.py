"""Merkle manifest of a table: block hashes by DuckDB in the executors, bucket roots and outer proofs by Spark.

A row is a leaf; the leaves of a source, ascending by id, form a tree of 16 children a node, and the roots of all sources,
ascending by source, form the tree above. Leaves travel in aligned buckets of 16^3 places, so three levels are computed within
one Arrow batch by ordered ``string_agg`` and ``sha256``; bucket roots are leaves of the next bucket up, and so on. Proofs
come down the same way: each bucket is joined, by its unique key, with the siblings above it.

Nulls: a null field is ``-``; a null source comes before all others, a null id after all others; a null id is never tampered
with. Rows with equal source and id are ordered by their leaves, and equal leaves are interchangeable. An empty text is a
field like any other (``0:``). Other columns are ignored. An empty table has no rows and no root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.llm.common import discard, doc_crc, own_session, store, table

FAN = 16
DEPTH = 3
BUCKET = FAN**DEPTH
#: Rows that a task sorts at most, about; packed runs of rows are no longer than a bucket.
SORTED = 500_000
MEMORY = "256MB"
#: Leaves of the buckets that one DuckDB query takes: with their siblings, some 3 KB a leaf, they must fit MEMORY. A bucket at least.
TOGETHER = 4 * BUCKET


# ---- the block engine: whole buckets of an Arrow batch in DuckDB ---------------------------------------------------

#: Nodes of each level within the buckets, with the text that they are the hash of.
_LEVELS = "leaf AS (SELECT b, i, h, lower(hex(digest)) AS node FROM items)" + "".join(
    f", s{k} AS MATERIALIZED (SELECT b, i // {FAN} AS i, any_value(h) AS h, string_agg(node, '' ORDER BY i) AS run, sha256(string_agg(node, '' ORDER BY i)) AS node"
    f" FROM {f's{k - 1}' if k > 1 else 'leaf'} WHERE h >= {k} GROUP BY b, i // {FAN})"
    for k in range(1, DEPTH + 1)
)
_ROOTS = f"WITH {_LEVELS} " + " UNION ALL ".join(f"SELECT b, node FROM {f's{k}' if k else 'leaf'} WHERE h = {k}" for k in range(DEPTH + 1)) + " ORDER BY b"
#: Each leaf with the siblings to its left and right at each level (null where its tree has no such level).
_SIDES = f"sides AS (SELECT t.b, t.i, t.node, {', '.join(f's{k}.run[:64 * ((t.i // {FAN ** (k - 1)}) % {FAN})] AS l{k}, s{k}.run[64 * ((t.i // {FAN ** (k - 1)}) % {FAN}) + 65:] AS r{k}' for k in range(1, DEPTH + 1))} FROM leaf t {' '.join(f'LEFT JOIN s{k} ON s{k}.b = t.b AND s{k}.i = t.i // {FAN**k}' for k in range(1, DEPTH + 1))})"
_PATHS = f"WITH {_LEVELS}, {_SIDES} SELECT list_filter([{', '.join(f'l{k}' for k in range(1, DEPTH + 1))}], lambda x: x IS NOT NULL) AS lefts, list_filter([{', '.join(f'r{k}' for k in range(1, DEPTH + 1))}], lambda x: x IS NOT NULL) AS rights FROM sides ORDER BY b, i"


def _proofs(above: int) -> str:
    """Proof digest and refolded root of each leaf; above: the most levels over a bucket."""
    inner = "||".join(f"coalesce(l{k} || r{k}, '')" for k in range(1, DEPTH + 1))
    steps, at = [], "CASE WHEN other IS NULL THEN node ELSE lower(hex(other)) END"
    for k in range(1, DEPTH + 1):
        steps.append(f"f{k} AS (SELECT * EXCLUDE (x), CASE WHEN l{k} IS NULL THEN x ELSE sha256(l{k} || x || r{k}) END AS x FROM {f'f{k - 1}' if k > 1 else 'f0'})")
    for k in range(1, above + 1):
        steps.append(f"g{k} AS (SELECT * EXCLUDE (x), CASE WHEN len(lefts) < {k} THEN x ELSE sha256(lefts[{k}] || x || rights[{k}]) END AS x FROM {f'g{k - 1}' if k > 1 else f'f{DEPTH}'})")
    first = f"f0 AS (SELECT sides.*, lefts, rights, {at} AS x, sha256({inner} || outer_proof) AS proof FROM sides JOIN heads USING (b) JOIN (SELECT b, i, digest, other FROM items) o USING (b, i))"
    return f"WITH {_LEVELS}, {_SIDES}, {', '.join([first, *steps])} SELECT node, proof, x FROM {f'g{above}' if above else f'f{DEPTH}'} ORDER BY b, i"


class Blocks:
    """One DuckDB connection of a task, for batch after batch of buckets."""

    def __init__(self):
        import duckdb

        self.con = duckdb.connect()
        for setting in ("threads = 1", f"memory_limit = '{MEMORY}'", "preserve_insertion_order = true"):
            self.con.execute(f"SET {setting}")

    def ask(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, t in tables.items():
            self.con.register(name, t)
        out = self.con.sql(sql).to_arrow_table()
        for name in tables:
            self.con.unregister(name)
        return out.combine_chunks()


def _pieces(batches):
    """The same buckets in pieces of TOGETHER leaves at most, however many buckets Spark puts into a batch."""
    for b in batches:
        first = b.column("items").offsets.to_numpy().astype(np.int64)
        low = 0
        while low < b.num_rows:
            high = max(low + 1, int(np.searchsorted(first, first[low] + TOGETHER, "right")) - 1)
            yield b.slice(low, high - low)
            low = high


def _flat(b: pa.RecordBatch) -> tuple[pa.Table, pa.StructArray, np.ndarray]:
    """Items of a batch of buckets as a table (b, i, h, digest, other), the items themselves, and their number by bucket."""
    col = b.column("items")
    items, lens = col.flatten(), np.diff(col.offsets.to_numpy()).astype(np.int64)
    at = np.repeat(np.arange(b.num_rows), lens)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)
    n = b.column("n").to_numpy(zero_copy_only=False)
    high = sum((n > FAN**k).astype(np.int64) for k in range(DEPTH))
    return pa.table({"b": at, "i": place, "h": high[at], "digest": items.field("digest"), "other": items.field("other")}), items, lens


def _string(a) -> pa.Array:
    return a.combine_chunks().cast(pa.string()) if isinstance(a, pa.ChunkedArray) else a.cast(pa.string())


def _roots(batches):
    blocks = Blocks()
    for b in _pieces(batches):
        got = blocks.ask(_ROOTS, items=_flat(b)[0])
        digest = pa.array([bytes.fromhex(x) for x in got.column("node").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("idx"), b.column("n"), digest], ["tree", "idx", "n", "digest"])


def _paths(batches):
    """Of each item of buckets with their own paths: the path to the top."""
    blocks = Blocks()
    for b in _pieces(batches):
        flat, items, lens = _flat(b)
        got, of = blocks.ask(_PATHS, items=flat), flat.column("b").to_numpy()
        below = [got.column(c).to_pylist() for c in ("lefts", "rights")]
        above = [b.column(c).to_pylist() for c in ("lefts", "rights")]
        both = [pa.array([x + up[k] for x, k in zip(own, of, strict=True)], pa.list_(pa.string())) for own, up in zip(below, above, strict=True)]
        first = np.repeat(b.column("idx").to_numpy() * BUCKET, lens)
        idx = pa.array(first + flat.column("i").to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("tree").take(pa.array(of)), idx, items.field("name"), *both, b.column("subroot").take(pa.array(of))], ["tree", "idx", "name", "lefts", "rights", "subroot"])


def _proven(batches):
    blocks = Blocks()
    for b in _pieces(batches):
        flat, items, _ = _flat(b)
        of = pa.array(flat.column("b").to_numpy())
        lefts, rights = (b.column(c).to_pylist() for c in ("lefts", "rights"))
        outer = ["".join(x + y for x, y in zip(l, r, strict=True)) for l, r in zip(lefts, rights, strict=True)]
        heads = pa.table({"b": np.arange(b.num_rows), "lefts": pa.array(lefts, pa.list_(pa.string())), "rights": pa.array(rights, pa.list_(pa.string())), "outer_proof": pa.array(outer, pa.string())})
        got = blocks.ask(_proofs(max(map(len, lefts))), items=flat, heads=heads)
        cols = [_string(got.column(c)) for c in ("node", "proof", "x")]
        yield pa.RecordBatch.from_arrays([items.field("id"), cols[0], b.column("subroot").take(of), *cols[1:]], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


# ---- Spark: places, buckets, roots upwards, proofs downwards -------------------------------------------------------

ITEM = "struct<id: bigint, name: string, digest: binary, other: binary>"


def _runs(batches):
    """Sorted rows of a partition as runs of one tree, at most a bucket long, each with its place among the tree's rows here."""
    from pyspark import TaskContext

    part, tree, at, first = TaskContext.get().partitionId(), None, 0, True
    for b in batches:
        if not b.num_rows:
            continue
        names = b.column("tree").combine_chunks() if isinstance(b.column("tree"), pa.ChunkedArray) else b.column("tree")
        codes = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1), b.num_rows]
        items = pa.StructArray.from_arrays([b.column(c) for c in ("id", "name", "digest", "other")], ["id", "name", "digest", "other"])
        offs, starts, trees = [0], [], []
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = names[int(i)].as_py()
            if first or own != tree:
                tree, at, first = own, 0, False
            for k in range(int(i), int(j), BUCKET):
                n = min(BUCKET, int(j) - k)
                trees.append(own)
                starts.append(at)
                offs.append(offs[-1] + n)
                at += n
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(trees), pa.int64()), pa.array(trees, pa.string()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), items)], ["part", "tree", "at", "items"])


def _buckets(rows: DataFrame, order: list) -> DataFrame:
    """(tree, idx, n, items): the rows of each tree in order, 4096 aligned places a bucket; n: rows of the tree."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORTED))
    keys = [F.col("tree"), *order]
    runs = store(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_runs, f"part long, tree string, at long, items array<{ITEM}>"), "merkle_runs")
    here = runs.groupBy("tree", "part").agg(F.sum(F.size("items")).alias("n"))
    w = Window.partitionBy("tree")
    before = F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = here.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(w).alias("n"))  # a row for each part that holds the tree
    start = F.col("before") + F.col("at")
    last = F.col("start") + F.size("items") - 1
    pieces = runs.join(places, ["tree", "part"]).withColumn("start", start).withColumn("idx", F.explode(F.sequence(F.expr(f"start div {BUCKET}"), F.floor(last / BUCKET).cast("long"))))
    low = F.greatest(F.col("start"), F.col("idx") * BUCKET)
    cut = F.slice("items", (low - F.col("start") + 1).cast("int"), (F.least(last, (F.col("idx") + 1) * BUCKET - 1) - low + 1).cast("int"))
    whole = pieces.select("tree", "idx", "n", F.struct(low.alias("low"), cut.alias("items")).alias("piece")).groupBy("tree", "idx").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    out = store(whole.select("tree", "idx", "n", F.flatten("pieces.items").alias("items")), "merkle_buckets")
    discard(runs)
    return out


def build_trees(rows: DataFrame, order: list) -> tuple[list[DataFrame], DataFrame]:
    """rows: tree, id, name, digest, other. Returns the buckets of each height, and (tree, top, subroot): the height of each tree's one top bucket, and its root."""
    levels, tops = [_buckets(rows, order)], None
    while True:
        roots = store(levels[-1].select("tree", "idx", "n", "items").mapInArrow(_roots, "tree string, idx long, n long, digest binary"), "merkle_roots")
        done = roots.where(F.col("n") <= BUCKET).select("tree", F.lit(len(levels) - 1).alias("top"), F.lower(F.hex("digest")).alias("subroot"))
        tops = done if tops is None else tops.unionAll(done)
        more = roots.where(F.col("n") > BUCKET)
        if more.isEmpty():
            return levels, tops
        item = F.struct(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("name"), "digest", F.lit(None).cast("binary").alias("other"))
        up = more.groupBy("tree", F.expr(f"idx div {BUCKET}").alias("idx")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("idx").alias("k"), item.alias("item")))).alias("kids"))
        levels.append(store(up.select("tree", "idx", F.expr(f"(n + {BUCKET - 1}) div {BUCKET}").alias("n"), F.col("kids.item").alias("items")), "merkle_buckets"))


_PATH = "tree string, idx long, name string, lefts array<string>, rights array<string>, subroot string"


def _with_paths(levels: list[DataFrame], trees: DataFrame) -> DataFrame:
    """The lowest buckets, each with the siblings above it. trees: tree, top, subroot, lefts, rights (above the tree)."""
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        own = trees.where(F.col("top") == k).select("tree", F.lit(0).cast("long").alias("idx"), "lefts", "rights", "subroot")
        paths = own if paths is None else own.unionAll(paths)
        joined = levels[k].join(paths, ["tree", "idx"]).select("tree", "idx", "n", "items", "lefts", "rights", "subroot")
        if k:
            paths = joined.mapInArrow(_paths, _PATH).drop("name")
    return joined


def merkle_manifest(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """leaves: tree (text that orders the trees), id, digest, other (the digest of a changed leaf, or null). Returns a row a leaf: doc_id, leaf, subroot, proof_sha256, folded_root; and the root."""
    rows = leaves.select("tree", F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("name"), "digest", "other")
    levels, tops = build_trees(rows, [F.col("id").asc_nulls_last(), F.col("digest")])
    tops = store(tops, "merkle_trees")
    none = F.lit(None)
    above, root = build_trees(tops.select(F.lit("").alias("tree"), none.cast("long").alias("id"), F.col("tree").alias("name"), F.unhex("subroot").alias("digest"), none.cast("binary").alias("other")), [F.col("name")])
    root = root.select("tree", "top", "subroot").head()
    if root is None:
        return leaves.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"), None
    empty = F.array().cast("array<string>")
    one = leaves.sparkSession.createDataFrame([tuple(root)], "tree string, top int, subroot string").select("*", empty.alias("lefts"), empty.alias("rights"))
    sources = store(_with_paths(above, one).mapInArrow(_paths, _PATH).select(F.col("name").alias("tree"), "lefts", "rights"), "merkle_sources")
    proven = _with_paths(levels, tops.join(sources, "tree")).mapInArrow(_proven, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proven, root.subroot


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_digest(*columns):
    """sha256 of the fields' length-prefixed texts, a null as ``-``; as binary."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = (F.pmod(doc_crc(), F.lit(5)) == 0) & F.col("text").rlike("[A-Z]")
    leaves = store(
        docs.select(
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("tree"), F.col("doc_id").alias("id"), row_digest(*rest, F.col("text")).alias("digest"),
            F.when(changed, row_digest(*rest, F.translate("text", _AZ, _AZ.lower()))).alias("other"),
        ),
        "merkle_leaves",
    )
    out, root = merkle_manifest(leaves)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _sql() -> str:
    """The same by plain SQL, up to six levels a tree (16,777,216 leaves)."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = lambda text: "||".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))::BIGINT[]), lambda acc, e: CASE WHEN e = -1 THEN xor(acc >> 1, 3988292384 * (acc & 1)) ELSE xor(acc, e) END), 4294967295)"
    ctes = [
        f"l AS MATERIALIZED (SELECT doc_id, source, sha256({fields('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({fields(f"translate(text, '{_AZ}', '{_AZ.lower()}')")}) END AS other FROM documents)",
        "a0 AS MATERIALIZED (SELECT source AS tree, doc_id AS id, coalesce(other, leaf) AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM l)",
    ]

    def up(p: str) -> None:
        for k in range(1, 7):
            ctes.append(f"{p}r{k} AS MATERIALIZED (SELECT tree, i // 16 AS i, string_agg(node, '' ORDER BY i) AS run FROM {p}{k - 1} WHERE n > 1 GROUP BY tree, i // 16)")
            ctes.append(f"{p}{k} AS MATERIALIZED (SELECT tree, i, sha256(run) AS node, count(*) OVER (PARTITION BY tree) AS n FROM {p}r{k})")

    def down(p: str) -> str:
        side = lambda k: (f"{p}r{k}.run[:64 * ((t.i // {16 ** (k - 1)}) % 16)]", f"{p}r{k}.run[64 * ((t.i // {16 ** (k - 1)}) % 16) + 65:]")
        joins = " ".join(f"LEFT JOIN {p}r{k} ON {p}r{k}.tree IS NOT DISTINCT FROM t.tree AND {p}r{k}.i = t.i // {16**k}" for k in range(1, 7))
        return f"SELECT t.*, {', '.join(f'{side(k)[0]} AS l{k}, {side(k)[1]} AS r{k}' for k in range(1, 7))} FROM {p}0 t {joins}"

    tops = lambda p: " UNION ALL ".join(f"SELECT tree, node FROM {p}{k} WHERE n = 1" for k in range(7))
    inner = "||".join(f"coalesce(l{k} || r{k}, '')" for k in range(1, 7))
    up("a")
    ctes.append(f"sub AS MATERIALIZED ({tops('a')})")
    ctes.append("b0 AS MATERIALIZED (SELECT 0 AS tree, tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n, node FROM sub)")
    up("b")
    ctes.append(f"root AS MATERIALIZED ({tops('b')})")
    ctes.append(f"outr AS MATERIALIZED (SELECT source, node AS subroot, {inner} AS outer_proof, {', '.join(f'l{k} AS ol{k}, r{k} AS orr{k}' for k in range(1, 7))} FROM ({down('b')}))")
    ctes.append(f"f0 AS (SELECT d.*, o.* FROM ({down('a')}) d JOIN outr o ON o.source IS NOT DISTINCT FROM d.tree)")
    for k in range(1, 13):
        a, b = (f"l{k}", f"r{k}") if k < 7 else (f"ol{k - 6}", f"orr{k - 6}")
        ctes.append(f"f{k} AS (SELECT * EXCLUDE (x), CASE WHEN {a} IS NULL THEN x ELSE sha256({a} || x || {b}) END AS x FROM f{k - 1})")
    return f"WITH {', '.join(ctes)} SELECT id AS doc_id, f12.node AS leaf, subroot, root.node AS root, sha256({inner} || outer_proof) AS proof_sha256, x AS folded_root, x = root.node AS verified FROM f12, root"


OP13_SQL = _sql()
