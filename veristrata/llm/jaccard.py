"""Operator 7, n-gram Jaccard join: groups of documents whose sets of word shingles overlap by 75 % or more, found exactly.

1. Which shingles more than one document has is asked of buckets (exchange). A document of n shingles with fewer than
   ceil(0.75 n) such shingles can link to nothing and drops out; that is most of a corpus.
2. Equal sets become one class, standing for all its documents.
3. Prefix filter: in one global order (rare shingles first) two linked sets share one of their first n - ceil(0.75 n) + 1.
   Each class is compared with the smallest document of the prefix shingle lists it shares most of; true links among these
   pairs already join most groups.
4. Lists of a shingle that still hold two groups or more are joined by signature trees: nodes hold the OR of their members'
   token bitmaps and the range of their sizes, and a dual traversal goes into a pair of nodes only if the greatest possible
   overlap reaches the smallest required one and the two are not one group already. Lists above BLOCK members are cut
   into bands of like size and those into blocks; only pairs of blocks of one band or of neighbouring ones, whose sets may
   link, are joined. Only bitmaps travel for this; the sets of members that the bounds leave follow, and are compared
   exactly.
5. Connected components of all links.

No step collects links or documents in the driver, and no list of documents is cut short. Null texts and texts without
words have empty sets and link with nothing. A null id sorts last; rows with equal ids are separate rows of one id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import Words, id_array, mix, pack, pair_hash, shifted_hash, store, table, tidy, unpack
from veristrata.llm.exchange import Exchange, answers_of, spread
from veristrata.operators.graph import connected_components

SHINGLE = 5
#: Bytes of a stored shingle hash, bits of a token bitmap, members of a block.
HASH_BYTES, BITMAP, BLOCK = 6, 2048, 2000
#: Ratio of sizes of a band: above 4/3, so that sets which link lie in one band or in neighbours; and blocks that a band can have.
BAND, BLOCKS = 1.34, 1 << 24
FANOUT = 8
U = np.uint64


def need(n: np.ndarray) -> np.ndarray:
    """Least overlap with any partner: ceil(0.75 n)."""
    return -(-75 * n // 100)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct shingle of each text, by document."""
    w = Words(data, offs, lower=True)
    n = np.diff(w.off)
    if not len(w.codes):
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = w.hashes()[w.codes]
    five = shifted_hash(h, SHINGLE)
    m = np.maximum(n - (SHINGLE - 1), 0)
    at = np.repeat(w.off[:-1] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
    doc, key = np.repeat(np.arange(len(n)), m), five[at] if len(at) else np.zeros(0, U)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = h[w.off[short]] + U(0x51ED270B)
        for j in range(1, SHINGLE - 1):
            more = n[short] > j
            whole = np.where(more, pair_hash(whole, h[np.minimum(w.off[short] + j, len(h) - 1)]), whole)
        doc, key = np.append(doc, short), np.append(key, mix(whole + n[short].astype(U)))
    order, _, first = spread(mix(key ^ mix(doc.astype(U) + U(1))))
    i = np.sort(order[first])
    i = i[np.argsort(doc[i], kind="stable")]
    return doc[i], key[i]


def _narrow(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])


def _widen(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").reshape(-1)


def document_sets(docs: DataFrame) -> DataFrame:
    """Stored: doc_id, n (set size), lo and hi (hash of the set), and for sets that can link, once in a packed row: the hashes of
    its shared shingles in the global order."""
    packed = pack(docs, "jaccard-texts")
    exchange = Exchange(packed.agg(F.sum("bytes")).first()[0] or 0)

    def keys_of(ids, data, offs):
        doc, key = shingles(data, offs)
        order, keys, first = spread(key)
        if not len(keys):
            return keys, keys
        return keys, np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)

    known = exchange.shared(packed, keys_of, "jaccard-shared")
    names = ["doc_id", "n", "lo", "hi", "shared"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def sets(key, left, right):
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, kinds, strict=True)})
        ids, data, offs = unpack(*(left.column(c)[0].as_py() for c in ("ids", "lens", "body")))
        doc, h = shingles(data, offs)
        m = len(ids)
        order, keys, first = spread(h)
        group = np.empty(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        heat = exchange.levels(keys, answers_of(right))[group] if len(h) else np.zeros(0, np.uint8)
        n = np.bincount(doc, minlength=m)
        bounds = np.append(0, np.cumsum(n))
        lo, hi = np.zeros(m, U), np.zeros(m, U)
        if len(h):
            full = np.flatnonzero(n)
            lo[full] = np.add.reduceat(mix(h), bounds[full])
            hi[full] = np.add.reduceat(mix(h * U(3) + U(5)), bounds[full])
        can = (n > 0) & (np.bincount(doc[heat > 0], minlength=m) >= need(n))
        tidy()
        seen, out = set(), [None] * m
        for i in np.flatnonzero(can).tolist():
            mark = (int(lo[i]), int(hi[i]))
            if mark in seen:
                continue
            seen.add(mark)
            a, b = bounds[i], bounds[i + 1]
            own, level = h[a:b], heat[a:b]
            own, level = own[level > 0], level[level > 0]
            own = own & U((1 << (8 * HASH_BYTES)) - 1)
            out[i] = _narrow(own[np.lexsort((own, level))]).tobytes()
        return pa.table({"doc_id": id_array(ids), "n": pa.array(n, pa.int64()), "lo": pa.array(lo.view(np.int64)), "hi": pa.array(hi.view(np.int64)), "shared": pa.array(out, pa.binary())})

    made = packed.select("src", "ids", "lens", "body").groupBy("src").cogroup(known.groupBy("src")).applyInArrow(sets, "doc_id long, n long, lo long, hi long, shared binary")
    return store(made, "jaccard-sets")


def _classes(sets: DataFrame) -> DataFrame:
    """Stored: one row for each distinct set that can link: rep (smallest id), n, shared."""
    able = sets.where("shared is not null")
    rep = sets.where("n > 0").groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"))
    one = able.groupBy("lo", "hi").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))
    return store(one.join(rep, ["lo", "hi"]).where("rep is not null").select("rep", "n", "shared"), "jaccard-classes")


def _prefixes(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rep, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n"))
            own = [_widen(x) for x in b.column("shared").to_pylist()]
            band = (np.log(np.maximum(n, 1)) / np.log(BAND)).astype(np.int32)
            take = [max(0, int(m - need(m) + 1 - (m - len(x)))) for m, x in zip(n, own, strict=True)]
            for i in range(0, len(own), 256):
                part = [x[:k] for x, k in zip(own[i : i + 256], take[i : i + 256], strict=True)]
                many = [len(x) for x in part]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part).view(np.int64)), pa.array(np.repeat(rep[i : i + 256], many)), pa.array(np.repeat(band[i : i + 256], many))], ["shingle", "rep", "band"])

    return classes.mapInArrow(run, "shingle long, rep long, band int")


def overlap(a: bytes, b: bytes) -> int:
    both = np.sort(np.concatenate([_widen(a), _widen(b)]))
    return int((both[1:] == both[:-1]).sum())


def linked(n: int, m: int, common: int) -> bool:
    return 100 * common >= 75 * (n + m - common)


def _verify(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose sets link."""

    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("a", "b", "n", "m", "x", "y")]
            good = [(p, q) for p, q, n, m, x, y in zip(*cols, strict=True) if 4 * min(n, m) >= 3 * max(n, m) and linked(n, m, overlap(x, y))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in good], pa.int64()), pa.array([q for _, q in good], pa.int64())], ["a", "b"])

    left = pairs.join(classes.select(F.col("rep").alias("a"), "n", F.col("shared").alias("x")), "a")
    both = left.join(classes.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("shared").alias("y")), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def bitmap_of(x: np.ndarray) -> np.ndarray:
    """The token bitmap of a set of hashes, as 64-bit words."""
    bits = np.zeros(BITMAP, np.uint8)
    bits[(x % U(BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits).view(U)


class SignatureTree:
    """Levels of nodes over some sets, leaves first: OR of bitmaps, most elements beyond the bits of a member, range of sizes, and
    the group where all members are of one (-1: several).

    Elements that two sets share lie on bits that both have, and all but the first on a bit count among those beyond: no two
    members of a pair of nodes share more than the bits of both ORs and the smaller number beyond.
    """

    def __init__(self, maps: np.ndarray, held: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        self.order = np.lexsort((maps[:, 0], groups, sizes))
        m, size, group = maps[self.order], sizes[self.order], groups[self.order]
        self.levels = [(m, held[self.order] - np.bitwise_count(m).sum(1, dtype=np.int64), size, size, group)]
        while len(self.levels[-1][0]) > 1:
            m, over, lo, hi, g = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            a, b = np.minimum.reduceat(g, at), np.maximum.reduceat(g, at)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.maximum.reduceat(over, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.where(a == b, a, -1)))


def candidates(one: SignatureTree, two: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal: the pairs of members (their numbers in each tree) that the bounds leave."""
    i = j = np.zeros(1, np.int64)
    a, b = len(one.levels) - 1, len(two.levels) - 1
    while True:
        ma, oa, la, ha, ga = one.levels[a]
        mb, ob, lb, hb, gb = two.levels[b]
        keep = (4 * ha[i] >= 3 * lb[j]) & (4 * hb[j] >= 3 * la[i]) & ((ga[i] != gb[j]) | (ga[i] < 0))
        i, j = i[keep], j[keep]
        least = -(-3 * (la[i] + lb[j]) // 7)  # overlap of sets that size: 0.75 / 1.75 of both
        ok = np.zeros(len(i), bool)
        for k in range(0, len(i), 4096):
            s = slice(k, k + 4096)
            ok[s] = np.bitwise_count(ma[i[s]] & mb[j[s]]).sum(1, dtype=np.int64) + np.minimum(oa[i[s]], ob[j[s]]) >= least[s]
        i, j = i[ok], j[ok]
        if a == 0 and b == 0:
            return one.order[i], two.order[j]
        if a >= b:
            a -= 1
            first, many = i * FANOUT, np.minimum(FANOUT, len(one.levels[a][0]) - i * FANOUT)
            i = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            j = np.repeat(j, many)
        else:
            b -= 1
            first, many = j * FANOUT, np.minimum(FANOUT, len(two.levels[b][0]) - j * FANOUT)
            j = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            i = np.repeat(i, many)


def tree_pairs(maps: np.ndarray, held: np.ndarray, sizes: np.ndarray, groups: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (numbers) of different groups that the bounds leave. side: False and True for the two blocks of a pair of blocks;
    pairs within a block are left to that block's own join."""
    if side is None:
        tree = SignatureTree(maps, held, sizes, groups)
        i, j = candidates(tree, tree)
        return i[i < j], j[i < j]
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    if not len(left) or not len(right):
        return left[:0], left[:0]
    i, j = candidates(*(SignatureTree(maps[s], held[s], sizes[s], groups[s]) for s in (left, right)))
    return left[i], right[j]


def tree_join(reps: list[int], sizes: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the sets that join groups, compared exactly where the bounds leave a pair."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = np.fromiter(map(len, sets), np.int64, len(sets))
    links = []
    for p, q in zip(*(x.tolist() for x in tree_pairs(np.stack([bitmap_of(x) for x in sets]), held, sizes, groups, side)), strict=True):
        a, b = root(int(groups[p])), root(int(groups[q]))
        if a != b:
            both = np.sort(np.concatenate([sets[p], sets[q]]))
            if linked(int(sizes[p]), int(sizes[q]), int((both[1:] == both[:-1]).sum())):
                parent[a] = b
                links.append((reps[p], reps[q]))
    return links


def marks_of(reps: np.ndarray, side: np.ndarray | None) -> tuple[int, int]:
    """Two hashes of the members of a list's own pairs, or of those of two blocks with their sides. No member, 0 included, adds nothing."""
    out = []
    for salt in (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)):
        who = mix(reps.astype(U) + salt)
        who = who if side is None else mix(who * U(2) + side.astype(U) + salt)
        out.append(int(np.bitwise_xor.reduce(who)) if len(who) else 0)
    return out[0], out[1]


def find_links(classes: DataFrame) -> DataFrame:
    """Stored links (a, b) between classes; their components are those of all links of 75 % or more."""
    posts = store(_prefixes(classes), "jaccard-prefixes")
    lists = posts.groupBy("shingle").agg(F.count("*").alias("c"), F.min("rep").alias("b")).where("c > 1")
    pairs = posts.join(lists, "shingle").where("rep <> b").groupBy("rep", "b").agg(F.count("*").alias("k"))
    best = pairs.groupBy("rep").agg(F.max(F.struct("k", -F.col("b"))).alias("s")).select(F.col("rep").alias("a"), (-F.col("s")["col2"]).alias("b"))
    links = store(_verify(best, classes), "jaccard-links")
    groups = connected_components(links)
    own = posts.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("shingle", "rep", "band", F.coalesce("component", "rep").alias("grp"))
    own = store(own, "jaccard-members")
    left = own.groupBy("shingle").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"), F.expr("bit_xor(xxhash64(rep, 7))").alias("x")).where("g0 <> g1")
    one = store(left.groupBy("c", "h", "x").agg(F.min("shingle").alias("shingle")).select("shingle", "c"), "jaccard-lists")
    bands = own.join(one.where(F.col("c") > BLOCK), "shingle").groupBy("shingle", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    bands = bands.groupBy("shingle").agg(F.collect_list(F.struct("band", "blocks")).alias("bands"))  # a band for each power of BAND
    members = own.join(one.join(bands, "shingle", "left"), "shingle")
    blocks = F.coalesce(F.get(F.filter("bands", lambda x: x["band"] == F.col("band")), F.lit(0))["blocks"], F.lit(1))
    place = lambda band, block: (band * BLOCKS + block).cast("int")
    mine = F.when(F.col("bands").isNull(), F.lit(0)).otherwise(place(F.col("band"), F.pmod(F.xxhash64("rep"), blocks)))
    near = F.filter("bands", lambda x: F.abs(x["band"] - F.col("band")) <= 1)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda i: place(x["band"], i))))
    members = members.select("shingle", "rep", "grp", mine.alias("mine"), F.explode(F.coalesce(others, F.array(F.lit(0)))).alias("other"))
    members = members.select("shingle", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "rep", "grp")

    def sketch(batches):
        for b in batches:
            sets = [_widen(x) for x in b.column("shared").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap_of(x).tobytes() for x in sets], pa.binary())], ["rep", "n", "held", "bits"])

    def look(key, t):
        shingle, p, q = (k.as_py() for k in key)
        maps = np.frombuffer(b"".join(t.column("bits").to_pylist()), U).reshape(t.num_rows, -1)
        rep, held, sizes, groups_, mine_ = (t.column(c).to_numpy() for c in ("rep", "held", "n", "grp", "mine"))
        i, j = tree_pairs(maps, held, sizes, groups_, None if p == q else mine_ == q)
        on = np.unique(np.append(i, j))
        mark, again = marks_of(rep[on], None if p == q else mine_[on] == q)
        out = {"mark": np.full(len(on), mark, U).view(np.int64), "again": np.full(len(on), again, U).view(np.int64), "many": np.full(len(on), len(on), np.int64), "shingle": np.full(len(on), shingle), "p": np.full(len(on), p), "q": np.full(len(on), q), "side": mine_[on] == q, "rep": rep[on], "grp": groups_[on]}
        return pa.table({c: pa.array(v, t_) for (c, v), t_ in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)})

    def join(key, t):
        p, q = key[1].as_py(), key[2].as_py()
        sizes, groups_, side = (t.column(c).to_numpy() for c in ("n", "grp", "side"))
        got = tree_join(t.column("rep").to_pylist(), sizes, [_widen(x) for x in t.column("shared").to_pylist()], groups_, None if p == q else side)
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    maps = store(classes.mapInArrow(sketch, "rep long, n long, held long, bits binary"), "jaccard-bitmaps")
    near = members.join(maps, "rep").select("shingle", "p", "q", "mine", "rep", "grp", "n", "held", "bits").groupBy("shingle", "p", "q").applyInArrow(look, "mark long, again long, many long, shingle long, p int, q int, side boolean, rep long, grp long")
    near = store(near, "jaccard-near")
    # of lists that leave the same members, one
    own_list = F.struct("shingle", "p", "q")
    single = near.groupBy("mark", "again", "many").agg(F.min(own_list).alias("l")).select("mark", "again", "many", F.col("l.shingle").alias("shingle"), F.col("l.p").alias("p"), F.col("l.q").alias("q"))
    near = near.join(single, ["mark", "again", "many", "shingle", "p", "q"])
    more = near.join(classes, "rep").select("shingle", "p", "q", "side", "rep", "grp", "n", "shared").groupBy("shingle", "p", "q").applyInArrow(join, "a long, b long")
    return store(links.unionByName(more), "jaccard-all-links")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id)."""
    sets = document_sets(docs)
    groups = connected_components(find_links(_classes(sets))).withColumnRenamed("node", "rep")
    rep = sets.where("n > 0").groupBy("lo", "hi").agg(F.min("doc_id").alias("rep")).join(groups, "rep", "left").select("lo", "hi", F.coalesce("component", "rep").alias("component"))
    light = sets.select("doc_id", "n", "lo", "hi")
    linked_ = light.where("n > 0").join(rep, ["lo", "hi"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return linked_.unionAll(light.where("n = 0").select("doc_id", "n", F.col("doc_id")))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS low FROM w UNION SELECT u.b, r.low FROM r JOIN u ON r.node = u.a WHERE r.low < u.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.low) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY w.doc_id, n.n
"""
