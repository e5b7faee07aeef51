"""Exact similarity join of documents on word shingles, by a MinHash LSH forest.

1. Each text's set of five-word shingles (64-bit hashes) gets a key and TREES labels. A label is DEPTH minhashes,
   a byte of each, first to last: a path in that tree's prefix trie, kept as one 64-bit number, so that labels in
   the order of unsigned numbers are the trie's leaves from left to right. Equal sets share a key and are one *class* from
   then on, so copies cost one row each.
2. Classes that agree in the shortest prefix that a descent may end at are brought together: they are a subtrie. That
   length is the longest at which pairs at the threshold meet in some tree with the wanted recall,
   1 - (1 - t^d)^trees. Subtries with the same members in several trees are brought together once, and descended in together.
3. A subtrie's members get their whole shingle sets. Descent begins at whole labels: runs that agree in a prefix in one of
   its trees are verified exactly, then prefixes are shortened by one in all these trees and what meets newly is
   verified, until the recall that the found pairs' similarities show is enough (each pair of similarity s was met with
   probability 1 - (1 - s^d)^trees, so it stands for the inverse of that many), or the shortest prefix is reached. Where
   fewer than EVIDENCE pairs were found nothing is concluded from them; the members of small subtries are verified at
   once. A pair counts in the tree of its longest common prefix, of several the first.
4. A subtrie of more than BLOCK members is dealt out as pairs of blocks, so a task holds two blocks. What leaves it grows
   with its members, not with its pairs: each member's number of links and a spanning forest of them.
5. Linked classes are joined into groups by alternating star contraction.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import unused, written

WORDS = 5
THRESHOLD = 0.8
TREES = 24
#: Levels of a trie; a byte each, so a label is a 64-bit number.
DEPTH = 8
RECALL = 0.99999
#: Measured recall at which a descent ends above the shortest prefix, and the least number of found pairs that measure it.
MEASURED, EVIDENCE = 0.99999, 500
BLOCK = 512
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def depth_for(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which pairs of this similarity meet in some tree with probability recall."""
    while depth > 1 and (1 - threshold**depth) ** trees > 1 - recall:
        depth -= 1
    return depth


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _seeded() -> None:
    """Workers hash strings alike only if their seed is fixed, which Spark's driver does; fail rather than miss links."""
    if os.environ.get("PYTHONHASHSEED", "random") == "random":
        raise RuntimeError("PYTHONHASHSEED isn't set in this worker")


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of the text's shingles; a text of fewer words is one shingle, one of none has none."""
    every = [w for w in _SPLIT.split(text or "") if w]
    if not every:
        return np.zeros(0, np.uint64)
    h = _mixed(np.fromiter(map(hash, every), np.int64, len(every)).view(np.uint64))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for j in range(min(width, len(h))):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def labels(sets: np.ndarray, trees: int) -> np.ndarray:
    """For each tree the label: a byte of each of DEPTH minhashes, the first one highest."""
    a, b = _permutations(trees * DEPTH)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    h = (sets >> np.uint64(32)).astype(np.uint32)
    h2 = sets.astype(np.uint32) | np.uint32(1)
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024, None] * a[None, :] + h2[at : at + 1024, None] * b[None, :]
        np.minimum(low, x.min(axis=0), out=low)
    return (_mixed(low.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8).reshape(trees, DEPTH).view(">u8")[:, 0].astype(np.uint64)


def _key(sets: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(sets.tobytes())


def signatures(documents: DataFrame, trees: int, width: int = WORDS) -> DataFrame:
    """doc_id, key (null: no words) and labels of each row of documents(doc_id, text)."""

    def sign(batches: Iterator):
        import pyarrow as pa

        _seeded()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, width) for t in part.column("text").to_pylist()]
                keys = [_key(s) if len(s) else None for s in sets]
                signed = [labels(s, trees).view(np.int64).tolist() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(signed, pa.list_(pa.int64()))], names=["doc_id", "key", "labels"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, key binary, labels array<long>")


def _members(classes: DataFrame, floor: int) -> DataFrame:
    """(key, tree, prefix, members): classes in subtries of two classes and more.

    Subtries are counted first, with partial sums, and joined back: a hot one is a skewed partition of a merge join,
    which adaptive execution splits, and no window holds it.
    """
    spread = classes.select("key", F.posexplode("labels").alias("tree", "label")).select("key", "tree", F.shiftrightunsigned("label", 8 * (DEPTH - floor)).alias("prefix"))
    spread = written(spread, "labels")
    counted = spread.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return spread.join(counted.hint("merge"), ["tree", "prefix"])


def _nodes(members: DataFrame) -> DataFrame:
    """(tree, prefix, node, trees): of subtries with the same classes in several trees, that of the first; trees has a bit for each."""
    h = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    nodes = members.groupBy("tree", "prefix", "members").agg(*h)
    same = nodes.groupBy("x1", "x2", "members").agg(F.min(F.struct("tree", "prefix")).alias("first"), F.bit_or(F.expr("shiftleft(1L, tree)")).alias("trees"))
    return same.select("first.tree", "first.prefix", F.xxhash64("first.tree", "first.prefix").alias("node"), "trees")


def _verified(rows: DataFrame, threshold: float, floor: int, measured: float, evidence: int) -> DataFrame:
    """(key, links, other): links that a subtrie (or pair of blocks) adds to a class, and one edge of its spanning forest."""

    def verify(batches: Iterator):
        held: list[tuple] = []
        place = None
        for batch in batches:
            columns = [batch.column(c) for c in ("node", "i", "j", "trees", "block", "key", "labels", "docs", "shingles")]
            for at in range(batch.num_rows):
                row = tuple(c[at] for c in columns)
                here = (row[0].as_py(), row[1].as_py(), row[2].as_py())
                if here != place:
                    if held:
                        yield from _links(held, place, threshold, floor, measured, evidence)
                    held, place = [], here
                held.append((row[3].as_py(), row[4].as_py(), row[5].as_py(), row[6].values.to_numpy(zero_copy_only=False), row[7].as_py(), np.frombuffer(row[8].as_py(), np.uint64)))
        if held:
            yield from _links(held, place, threshold, floor, measured, evidence)

    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(verify, "key binary, links long, other binary")


def measured_recall(similarities: np.ndarray, depth: int, trees: int) -> float:
    """Share of pairs that prefixes of this depth bring together, as the similarities of those that met show it."""
    if not len(similarities):
        return 0.0
    return float(len(similarities) / (1 / (1 - (1 - similarities**depth) ** trees)).sum())


def _first_met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows of labels, the tree of their longest common prefix, of several the first."""
    differ = (x ^ y)[:, :, None] >> (np.arange(DEPTH - 1, -1, -1).astype(np.uint64) * np.uint64(8))
    return np.argmax((differ == 0).sum(axis=2), axis=1)


def _descended(signed: np.ndarray, sets: list[np.ndarray], trees: list[int], apart: np.ndarray | None, threshold: float, floor: int, measured: float, evidence: int) -> np.ndarray:
    """Which members of these trees' common subtrie are linked, by pairs whose longest common prefix is in one of the trees.

    apart: pairs that are in different blocks, if these alone count here.
    """
    n, every = signed.shape
    sizes = np.fromiter(map(len, sets), np.int64, n)
    linked = np.zeros((n, n), bool)
    known = np.eye(n, dtype=bool) if apart is None else ~apart
    found = np.zeros(0)

    def verify(rows: np.ndarray) -> None:
        nonlocal found
        open_ = np.triu(~known[np.ix_(rows, rows)], 1)
        a, b = np.nonzero(open_)
        if not len(a):
            return
        if len(a) <= 2 * len(rows):
            both = np.array([len(np.intersect1d(sets[rows[i]], sets[rows[j]], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        else:
            both = _common([sets[i] for i in rows.tolist()])[a, b]
        a, b = rows[a], rows[b]
        known[a, b] = known[b, a] = True
        either = sizes[a] + sizes[b] - both
        close = both >= threshold * either - 1e-9
        a, b, share = a[close], b[close], both[close] / either[close]
        if len(a):
            own = np.isin(_first_met(signed[a], signed[b]), trees)
            linked[a[own], b[own]] = linked[b[own], a[own]] = True
            found = np.concatenate([found, share[own]])

    if n <= 64:
        verify(np.arange(n))
        return linked
    orders = {t: np.argsort(signed[:, t], kind="stable") for t in trees}
    for depth in range(DEPTH, floor - 1, -1):
        for t, order in orders.items():
            prefix = signed[order, t] >> np.uint64(8 * (DEPTH - depth))
            for rows in np.split(order, np.flatnonzero(prefix[1:] != prefix[:-1]) + 1):
                if len(rows) > 1:
                    verify(np.sort(rows))
        if len(found) >= evidence and measured_recall(found, depth, every) >= measured:
            break
    return linked


def _links(held: list[tuple], place: tuple, threshold: float, floor: int, measured: float, evidence: int):
    import pyarrow as pa

    keys = [x[2] for x in held]
    signed = np.stack([x[3] for x in held]).view(np.uint64)
    block = np.array([x[1] for x in held])
    apart = block[:, None] != block[None, :] if place[1] != place[2] else None
    trees = [t for t in range(signed.shape[1]) if held[0][0] >> t & 1]
    linked = _descended(signed, [x[5] for x in held], trees, apart, threshold, floor, measured, evidence)
    seen = np.zeros(len(keys), bool)
    other = np.full(len(keys), -1)
    for root in range(len(keys)):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            other[new] = root
            todo.extend(new.tolist())
    some = np.flatnonzero(linked.any(axis=1))
    if len(some):
        docs = np.array([x[4] for x in held], np.float64)
        counts = (linked.astype(np.float64) @ docs).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in some], pa.binary()), pa.array(counts[some]), pa.array([keys[other[i]] if other[i] >= 0 else None for i in some], pa.binary())],
            names=["key", "links", "other"],
        )


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, by products of slices of the incidence matrix."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[column] > 1  # what one set alone holds is in no intersection
    column = (np.cumsum(counts > 1) - 1)[column[shared]]
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        some = np.zeros((len(sets), width), np.float32)
        some[row[a:b], column[a:b] - first] = 1
        out += some @ some.T
    return np.rint(out).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node of node's component.

    Alternating large-star and small-star contraction; each round's edges are written to the shared
    folder, and rounds end when they don't change any more.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        # larger neighbours go to the least
        large = both.where("b > a").join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        # smaller neighbours, and the node itself, go to the least of them
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(low.select("a", F.col("least").alias("b"))).where("a != b").distinct()
        edges = written(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def join_documents(documents: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, width: int = WORDS, block: int = BLOCK, measured: float = MEASURED, evidence: int = EVIDENCE) -> DataFrame:
    """A row per document(doc_id, text): doc_id, class_id, n_links, key (of its class), root (key of its group).

    Two documents are linked if the Jaccard similarity of their shingle sets is threshold or more.
    class_id is the smallest doc_id in the document's group (linked directly or through others), n_links
    the number of other documents it is linked to, copies counted. Texts of fewer words than a shingle
    are one shingle; null texts and texts of no word have no links and are groups of their own. Repeated
    rows are copies. Prefixes are never cut shorter than a pair at the threshold needs to meet with probability recall; recall = 1
    cuts down to one minhash, where such a pair is missed once in 10^16, at the price of far more candidates. A null doc_id doesn't name a group unless no document of it has an id; then class_id is null.
    """
    floor = depth_for(threshold, trees, DEPTH, recall)
    signed = written(signatures(documents, trees, width), "signed")
    classes = signed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least_id"), F.first("labels").alias("labels"))
    classes = written(classes, "classes")
    members = written(_members(classes, floor), "members")
    met = members.join(_nodes(members).hint("merge"), ["tree", "prefix"])
    met = met.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    # a member of block b is in the pairs (b, b), (b, j) and (i, b)
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as i, greatest(x, block) as j))")
    met = written(met.select("key", "node", "trees", "block", F.explode(pairs).alias("p")).select("key", "node", "trees", "block", "p.i", "p.j"), "met")
    wanted = met.select("key").distinct()
    signs = classes.join(wanted, "key", "left_semi").select("key", "labels", "docs")
    sets = written(_shingle_sets(documents, signed, wanted, width).join(signs, "key"), "sets")
    found = written(_verified(met.join(sets.hint("merge"), "key"), threshold, floor, measured, evidence), "links")
    groups = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    ids = classes.select("key", "docs", "least_id").join(groups.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    ids = written(ids.withColumn("root", F.coalesce("root", "key")), "grouped")
    named = ids.groupBy("root").agg(F.min("least_id").alias("class_id"))
    by_key = ids.join(named, "root").select("key", "root", "class_id", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = signed.select("doc_id", "key")
    alone = rows.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "key", F.col("key").alias("root"))
    return rows.where("key is not null").join(by_key, "key").select("doc_id", "class_id", "n_links", "key", "root").unionByName(alone)


def _shingle_sets(documents: DataFrame, signed: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of the wanted classes, each from one document."""
    source = signed.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("id"))
    # classes none of whose documents has an id are found by key among rows without one
    unnamed = source.where("id is null").select("key")
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def build(batches: Iterator):
        import pyarrow as pa

        _seeded()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [s for s in map(lambda t: shingles(t, width), batch.slice(at, 256).column("text").to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"])

    schema = "key binary, shingles binary"
    # always a merge join: candidates grow with the corpus
    named = rows.join(source.where("id is not null").select("id").distinct().hint("merge"), "id", "left_semi").select("text").mapInArrow(build, schema)
    others = rows.where("id is null").select("text").mapInArrow(build, schema)
    # rows that share a doc_id may bring sets that nobody wants, or one set twice
    return named.join(wanted, "key", "left_semi").unionByName(others.join(unnamed, "key", "left_semi")).dropDuplicates(["key"])


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """documents with one row of each group of join_documents(): that of the smallest doc_id.

    Texts without a word are no copies of each other and all stay. Rows that repeat a doc_id or have none
    are told apart by their shingles; of equal ones in both, one stays.
    """
    found = written(join_documents(documents, **options), "joined")
    plain = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    if plain:
        return documents.join(found.where("doc_id = class_id").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*documents.columns)
    from pyspark.sql import types as T

    width, at_text = options.get("width", WORDS), documents.columns.index("text")
    key, first_id = unused(documents, "key", "first_id")

    def add_key(batches: Iterator):
        import pyarrow as pa

        _seeded()
        for batch in batches:
            sets = (shingles(t, width) for t in batch.column(at_text).to_pylist())
            keys = pa.array([_key(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, key])

    keyed = documents.mapInArrow(add_key, T.StructType([*documents.schema.fields, T.StructField(key, T.BinaryType())]))
    first = found.where("key is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")).select(F.col("f.doc_id").alias(first_id), F.col("f.key").alias(key))
    one = keyed.join(first, key).where(F.col("doc_id").eqNullSafe(F.col(first_id))).dropDuplicates([key])
    return one.select(*documents.columns).unionByName(keyed.where(F.col(key).isNull()).select(*documents.columns))
