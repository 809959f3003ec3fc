"""N-gram Jaccard join by MinHash LSH (operator 4).

Two documents are linked when the Jaccard similarity of their sets of word shingles is at least
``threshold``. Words are runs of letters and digits of the lower-cased text; a shingle is ``n``
consecutive words, and a text of fewer words (but at least one) is one shingle of all its words.

1. Equal shingle sets are one class, aggregated before the shuffle: copies are never paired.
2. Each class gets TREES * DEPTH MinHash values: one label of DEPTH values for each of TREES
   prefix tries. The shortest prefix that a trie may be asked for is the longest one at which a
   pair at the threshold meets in some trie with probability of at least ``recall`` (5 of 8
   values): down to it, every level is searched; below it, none needs to be.
3. Classes with equal shortest prefixes form a bucket: a subtree of a trie. A task holds its
   classes sorted by the rest of their labels, so the matches of a longer prefix are runs of
   neighbours. It starts with whole labels, links what the sketches find plausible, and shortens
   the prefix level by level only while some of its classes are still apart; classes that are
   linked already are not compared again. Large buckets are cut into tiles of bounded size, and a
   tile emits only a spanning forest, so no bucket emits all its pairs. Connected tiles give
   candidate components.
4. Exact verification: within a component, tiles of shingle sets compute every Jaccard similarity
   by set intersection; a tile emits link counts per class and a spanning forest of the links.

Defined results: texts without any word (null, empty, marks only) have no shingles, no links and
a class of their own. Links count the other rows at or above the threshold, copies included.
The group of a row is the smallest ``doc_id`` that links reach, a null one last. Rows that share
a ``doc_id`` are told apart by their texts. Extra columns have no influence. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksmith.llm.common import (checkpointed, keep_or_drop_ids, map_batches, min_label_components,
                                  one_of_tied, packed, read, short_batches, text_column, unpacked)

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.99999
#: Values of the sketch that tiles compare (one byte each), and the share of equal ones that a
#: plausible link has: at a similarity of 0.8 fewer come out with a probability under 1e-9.
SKETCH = 192
PLAUSIBLE = 0.62
#: Bits of a label's value that are kept below the shortest prefix: DEPTH of them fit a long.
BRANCH_BITS = 8
#: Members of a tile.
TILE = 256
#: Distinct shingles compared at a time in a tile.
SLAB = 8192

WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(4)
_MUL = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shortest_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                   recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets with the wanted recall: prefixes
    are shortened to this depth and no further."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    table = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(words))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for j in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - size + 1 + j])
    return np.unique(out)


def minhashes(s: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of a shingle set."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 512):
        block = s[i:i + 512, None] * _MUL + _ADD
        np.minimum(low, block.min(axis=0), out=low)
    return low


def _prefix_keys(values: np.ndarray, depth: int) -> np.ndarray:
    """Per trie, a hash of its first ``depth`` values; ``values`` is rows x (TREES * DEPTH)."""
    v = values.reshape(len(values), TREES, DEPTH)
    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (len(values), TREES)).copy()
    for d in range(depth):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + v[:, :, d])
    return key


def _branches(values: np.ndarray, depth: int) -> np.ndarray:
    """Per trie, the values below ``depth`` as one number, BRANCH_BITS of each: the labels of a
    bucket sort by it as they lie in the trie."""
    v = _mixed(values.reshape(len(values), TREES, DEPTH))
    out = np.zeros((len(values), TREES), dtype=np.uint64)
    for d in range(depth, DEPTH):
        out = (out << np.uint64(BRANCH_BITS)) | (v[:, :, d] & np.uint64((1 << BRANCH_BITS) - 1))
    return out


def signatures(docs: DataFrame, depth: int) -> DataFrame:
    """``doc_id, th, key, size, tries, branches, sketch``: a row's shingle-set digest, its size,
    the shortest prefix and the rest of its label in every trie, and the sketch."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(
        "th long, key binary, size long, tries array<long>, branches array<long>, "
        "sketch binary").fields])

    def run(batch: pa.RecordBatch) -> dict:
        key, size, values, where = [], [], [], []
        for i, t in enumerate(batch.column("_t").to_pylist()):
            s = shingles(t)
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            size.append(len(s))
            if len(s):
                values.append(minhashes(s))
                where.append(i)
        tries, branches, sketch = ([None] * len(key) for _ in range(3))
        if values:
            v = np.array(values)
            keys = _prefix_keys(v, depth).view(np.int64)
            rest = _branches(v, depth).view(np.int64)
            bits = (_mixed(v[:, :SKETCH]) & np.uint64(255)).astype(np.uint8)
            for j, i in enumerate(where):
                tries[i], branches[i], sketch[i] = keys[j], rest[j], bits[j].tobytes()
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "key": key,
                "size": size, "tries": pa.array(tries, type=pa.list_(pa.int64())),
                "branches": pa.array(branches, type=pa.list_(pa.int64())), "sketch": sketch}

    source = docs.select("doc_id", text_column().alias("_t")).withColumn("th", F.xxhash64("_t"))
    return map_batches(source, run, schema)


class _Forest:
    """Union-find over the members of a tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def join_all(self, linked: np.ndarray) -> None:
        """Join the pairs that a boolean matrix marks."""
        for i in range(len(linked)):
            for j in np.flatnonzero(linked[i]).tolist():
                if self.up[j] != self.up[i]:
                    self.join(i, j)

    def edges(self) -> list[tuple[int, int]]:
        return [(i, self.root(i)) for i in range(len(self.up)) if self.root(i) != i]


def plausible_forest(branch: np.ndarray, bits: np.ndarray, levels: int) -> _Forest:
    """A spanning forest of the plausible links of a bucket, whose members are sorted by
    ``branch``: the ``levels`` values that follow the bucket's prefix. Runs of equal whole labels
    come first; the prefix is shortened while members are apart, down to the bucket itself."""
    n = len(branch)
    forest, apart, least = _Forest(n), n - 1, PLAUSIBLE * SKETCH
    for level in range(levels + 1):
        if not apart:
            break
        # a shift by all bits of a number is not defined, and all of the bucket is one run then
        prefix = branch >> np.uint64(BRANCH_BITS * level) if level < levels else np.zeros(n)
        edges = np.append(np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])), n)
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for i in range(low, high - 1):
                own = forest.root(i)
                others = [j for j in range(i + 1, high) if forest.up[j] != own]
                if not others:
                    continue
                close = (bits[others] == bits[i]).sum(axis=1) >= least
                for k in np.flatnonzero(close).tolist():
                    if forest.root(others[k]) != forest.root(i):
                        forest.join(i, others[k])
                        apart -= 1
    return forest


def tiled(members: DataFrame, group: list[str], tile: int = TILE) -> DataFrame:
    """Members of groups dealt to tiles: a row per pair of blocks that a member belongs to.

    A group of n has ``ceil(n / tile)`` blocks, so its rows grow as n * n / tile, its tiles hold
    about two blocks each, and two members of a group share at least one tile. Needs the group
    size ``n`` and the member id ``rep``.
    """
    blocks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    return (members.withColumn("blocks", blocks).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            # with one's own block only where there is no other to share
            .filter((F.col("other") != F.col("own")) | (F.col("blocks") == 1))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))


def candidate_edges(classes: DataFrame, depth: int, tile: int = TILE) -> DataFrame:
    """``(a, b)``: a spanning forest per tile of the plausible links of classes that share a
    prefix of at least ``depth`` values."""
    prefixes = classes.select("rep", F.posexplode(F.arrays_zip("tries", "branches")).alias(
        "tree", "at")).select("rep", "tree", F.col("at.tries").alias("prefix"),
                              F.col("at.branches").alias("branch"))
    shared = (prefixes.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"))
              .filter("n > 1"))
    met = checkpointed(prefixes.join(shared, ["tree", "prefix"]))
    sketches = keep_or_drop_ids(classes.select("rep", "sketch"), met.select("rep").distinct(),
                                ["rep"], "left_semi")
    tiles = (tiled(met, ["tree", "prefix"], tile)
             .join(sketches, "rep").groupBy("tree", "prefix", "i", "j")
             .agg(F.collect_list(F.struct("branch", "rep", "sketch")).alias("m")))

    def run(batch: pa.RecordBatch) -> dict:
        a, b = [], []
        for rows in batch.column("m").to_pylist():
            # the trie of the bucket: its labels in order
            rows.sort(key=lambda r: (r["branch"] % (1 << 64), r["rep"]))
            bits = np.frombuffer(b"".join(r["sketch"] for r in rows), dtype=np.uint8)
            branch = np.array([r["branch"] for r in rows], dtype=np.int64).view(np.uint64)
            forest = plausible_forest(branch, bits.reshape(len(rows), SKETCH), DEPTH - depth)
            # stars around the smallest class, so the tries of a group give the same edges
            least: dict[int, bytes] = {}
            for i, r in enumerate(rows):
                top = forest.root(i)
                least[top] = min(least.get(top, r["rep"]), r["rep"])
            for i, r in enumerate(rows):
                if r["rep"] != least[forest.root(i)]:
                    a.append(r["rep"])
                    b.append(least[forest.root(i)])
        return {"a": a, "b": b}

    return map_batches(tiles.select("m"), run, "a binary, b binary").distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 slabs of the shared shingles."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    value, at, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    use = shared[at]
    owner, column = owner[use], column[at[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((n, n), dtype=np.float32)
    width = int(shared.sum())
    for low in range(0, width, SLAB):
        a, b = np.searchsorted(column, (low, low + SLAB))
        slab = np.zeros((n, min(SLAB, width - low)), dtype=np.float32)
        slab[owner[a:b], column[a:b] - low] = 1
        total += slab @ slab.T
    size = np.array([len(s) for s in sets])
    total[np.arange(n), np.arange(n)] = size
    return total.astype(np.int64)


def verified_links(members: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``(rep, links, root)`` per tile and member of a candidate component: the rows linked to
    it there, and the member that its links lead to.

    Needs ``component, n, rep, times (rows of the class), s (its shingles)``. A pair inside one
    block meets in several tiles and counts only in the first one.
    """
    tiles = (tiled(members, ["component"], tile)
             .groupBy("component", "i", "j", "blocks")
             .agg(F.collect_list(F.struct("rep", "times", "own", "s")).alias("m")))

    def run(batch: pa.RecordBatch) -> dict:
        rep, links, root = [], [], []
        for rows, i, j, blocks in zip(*(batch.column(c) for c in ("m", "i", "j", "blocks")),
                                      strict=True):
            rows, i, j, blocks = rows.as_py(), i.as_py(), j.as_py(), blocks.as_py()
            rows.sort(key=lambda r: r["rep"])
            sets = [np.frombuffer(r["s"], dtype=np.uint64) for r in rows]
            size = np.array([len(s) for s in sets])
            both = intersections(sets)
            union = size[:, None] + size[None, :] - both
            linked = both >= threshold * union - 1e-9
            np.fill_diagonal(linked, False)
            own = np.array([r["own"] for r in rows])
            inner = own[:, None] == own[None, :]
            # block b's inner pairs count in its tile with the smallest partner
            first = np.array([blocks == 1 or (j if o == i else i) == (0 if o else 1) for o in own])
            counted = linked & (~inner | first[:, None])
            times = np.array([r["times"] for r in rows])
            forest = _Forest(len(rows))
            forest.join_all(linked)
            for k, r in enumerate(rows):
                n = int(times[counted[k]].sum())
                top = forest.root(k)
                if n or top != k:
                    rep.append(r["rep"])
                    links.append(n)
                    root.append(rows[top]["rep"])
        return {"rep": rep, "links": links, "root": root}

    return map_batches(tiles, run, "rep binary, links long, root binary")


def _shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(rep, s)``: the shingles of the representatives of candidate classes."""
    ids = wanted.select("low.doc_id", "low.th")
    source = docs.select("doc_id", text_column().alias("_t")).withColumn("th", F.xxhash64("_t"))
    rows = keep_or_drop_ids(source, ids, ["doc_id", "th"], "left_semi")
    schema = T.StructType([docs.schema["doc_id"],
                           *T.StructType.fromDDL("th long, s binary").fields])

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th"),
                "s": [shingles(t).tobytes() for t in batch.column("_t").to_pylist()]}

    return map_batches(rows, run, schema).dropDuplicates(["doc_id", "th"])


def _place(doc_id: str, th: str):
    """Order of rows inside a group: smallest document first, null ones last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"),
                    F.col(th).alias("th"))


def judge(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
          tile: int = TILE) -> DataFrame:
    """``doc_id, th, class_id, n_links, text_class, kept, worded`` for every row; ``kept`` marks
    the rows at the first place of their group."""
    short_batches(docs.sparkSession)
    depth = shortest_depth(threshold, TREES, DEPTH, recall)
    signed = checkpointed(signatures(docs, depth))
    grouped = signed.filter("key is not null").groupBy("key").agg(
        F.min(_place("doc_id", "th")).alias("low"), F.count(F.lit(1)).alias("times"),
        F.first("tries").alias("tries"), F.first("branches").alias("branches"),
        F.first("sketch").alias("sketch"))
    classes = checkpointed(grouped.select(
        F.col("key").alias("rep"), "low", "times", "tries", "branches", "sketch"))
    candidates = min_label_components(candidate_edges(classes, depth, tile))
    components = candidates.select(F.col("node").alias("rep"), F.col("label").alias("component"))
    n_of = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    wanted = checkpointed(classes.select("rep", "low", "times").join(components, "rep"))
    sets = _shingle_table(docs, wanted)
    members = (wanted.join(n_of, "component")
               .join(sets, wanted["low.doc_id"].eqNullSafe(sets["doc_id"])
                     & (wanted["low.th"] == sets["th"]))
               .select("component", "n", "rep", "times", "s"))
    links = checkpointed(verified_links(members, threshold, tile))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = min_label_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = checkpointed(classes.select("rep", "low").join(
        groups.select(F.col("node").alias("rep"), "label"), "rep"))
    first = linked.groupBy("label").agg(F.min("low").alias("first"))
    ends = linked.join(first, "label").select("rep", "first").join(counts, "rep", "left")
    named = checkpointed(classes.select("rep", "low", "times").join(ends, "rep", "left").select(
        "rep", "times", F.col("low.doc_id").alias("text_class"),
        F.coalesce("first", "low").alias("first"),
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    return _attach(signed, named)


def _attach(signed: DataFrame, named: DataFrame) -> DataFrame:
    """Give every row its class; classes of many rows are looked up by broadcast (there are at
    most 1000 that hold a thousandth of all rows)."""
    total = signed.count()
    rows = signed.select("doc_id", "th", F.col("key").alias("rep"))
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    cols = ["doc_id", "th", F.col("first.doc_id").alias("class_id"), "n_links", "text_class",
            mine.alias("kept"), F.lit(True).alias("worded")]
    alone = rows.filter("rep is null").select(
        "doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("doc_id").alias("text_class"), F.lit(True).alias("kept"), F.lit(False).alias("worded"))
    worded = rows.filter("rep is not null")
    hot = named.filter(F.col("times") * 1000 >= F.lit(total))
    often = worded.join(F.broadcast(hot), "rep").select(*cols)
    rest = worded.join(F.broadcast(hot.select("rep")), "rep", "left_anti")
    return often.unionByName(rest.join(named, "rep").select(*cols)).unionByName(alone)


def near_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_links, text_class`` for every row.

    ``class_id`` is the smallest ``doc_id`` of the row's group, ``n_links`` the other rows at or
    above the threshold, ``text_class`` the smallest ``doc_id`` with the same shingle set.
    """
    return judge(docs, threshold).select("doc_id", "class_id", "n_links", "text_class")


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay: the first of each group of linked ones, all their columns.

    Rows that repeat ``doc_id`` and text are one document; texts without words all stay.
    """
    judged = checkpointed(judge(docs, threshold))
    keyed = packed(docs, doc=F.col("doc_id"), th=F.xxhash64(text_column()))
    gone = judged.filter("not kept").select(F.col("doc_id").alias("doc"), "th").distinct()
    kept = keep_or_drop_ids(keyed, gone, ["doc", "th"], "left_anti")
    tied = checkpointed(judged.filter("kept and worded").groupBy(F.col("doc_id").alias("doc"), "th")
                        .count().filter("count > 1").select("doc", "th"))
    return unpacked(one_of_tied(kept, tied, ["doc", "th"]))


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(read(spark, sf_dir, "documents"))


#: DuckDB form of ``op4_near_join``: every pair that shares a shingle, verified.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(
           generate_series(1, greatest(len(words) - 4, 1)),
           lambda i: array_to_string(words[i:i + 4], ' ')))) AS s
  FROM w WHERE len(words) > 0
), classes AS (
  SELECT s, min(doc_id) AS rep, count(*) AS times, len(s) AS size FROM sets GROUP BY s
), inv AS (
  SELECT rep, size, unnest(s) AS g FROM classes
), pairs AS (
  SELECT x.rep AS a, y.rep AS b, x.size AS sa, y.size AS sb, count(*) AS c
  FROM inv x JOIN inv y ON x.g = y.g AND x.rep < y.rep
   AND 10 * least(x.size, y.size) >= 8 * greatest(x.size, y.size)
  GROUP BY ALL HAVING 10 * count(*) >= 8 * (x.size + y.size - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(rep, other) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT reach.rep, links.b FROM reach JOIN links ON reach.other = links.a
), named AS (
  SELECT rep, min(other) AS class_id FROM reach GROUP BY rep
), linked AS (
  SELECT a AS rep, sum(times) AS n FROM links JOIN classes ON classes.rep = links.b GROUP BY a
), per_class AS (
  SELECT c.s, c.rep, n.class_id, CAST(coalesce(l.n, 0) + c.times - 1 AS BIGINT) AS n_links
  FROM classes c JOIN named n USING (rep) LEFT JOIN linked l USING (rep)
)
SELECT w.doc_id, coalesce(p.class_id, w.doc_id) AS class_id, coalesce(p.n_links, 0) AS n_links,
       coalesce(p.rep, w.doc_id) AS text_class
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN per_class p ON p.s = sets.s
"""
