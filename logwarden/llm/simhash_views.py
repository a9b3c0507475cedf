"""Near-duplicates at a stated similarity: SimHash over samples of shingles, then exact Jaccard.

A 64-bit fingerprint of a whole text moves by ten bits and more at a similarity of 0.8,
too far for a search that scales. Here a text has one fingerprint per view, each the
SimHash of the few shingles that the view's hash puts first. The bits of a view depend on
one sample and so stand or fall together: they form one partition each, probed at
threshold 0, and a pair at the stated similarity agrees in some view almost surely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import share, without, written
from logwarden.llm.simhash_dedup import components, majority, shingle_hashes, signed
from logwarden.llm.substring_dedup import _chosen

#: Views, and the shingles that each samples. A pair of similarity s agrees in a view with
#: probability s ** SAMPLE or so, and in none of them with (1 - s ** SAMPLE) ** VIEWS: 0.002 at 0.8.
VIEWS, SAMPLE = 12, 4
#: Members of a cell that are all compared with each other; of larger ones each is first compared
#: with the ``PIVOTS`` members nearest to the cell's majority, then as ``_open_pairs`` says.
CELL_PAIRS, PIVOTS = 8, 2
#: Rows of one shingle that meet in one block.
BLOCK_ROWS = 256
#: Texts that tell which shingles are frequent, and how many shingles are ordered by that at most.
SAMPLED, FREQUENT = 5_000, 100_000
#: Bytes of shingle sets that a task remembers while it compares pairs.
KEPT_BYTES = 16 << 20


def _distinct(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or b"").lower(), size))


def _views(rows: DataFrame, size: int) -> DataFrame:
    """Per row: id, key, node (hash of the words), whole fingerprint, and one fingerprint per view."""
    seeds = np.array([xxhash.xxh64_intdigest(b"view %d" % k) for k in range(VIEWS)], dtype=np.uint64)

    def work(batches):
        for batch in batches:
            nodes, wholes, views = [], [], []
            for text in batch.column(2):
                lowered = (text.as_py() or b"").lower()
                shingles = np.unique(shingle_hashes(lowered, size))
                nodes.append(signed(xxhash.xxh64_intdigest(b" ".join(lowered.split()))))
                wholes.append(signed(majority(shingles)))
                mine = []
                for k in range(VIEWS if len(shingles) else 0):
                    order = (shingles ^ seeds[k]) * np.uint64(0xBF58476D1CE4E5B9)
                    order = (order ^ (order >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                    first = np.argpartition(order, SAMPLE - 1)[:SAMPLE] if len(order) > SAMPLE else slice(None)
                    mine.append(signed(majority(shingles[first])))
                views.append(mine)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, type=pa.int64()), pa.array(wholes, type=pa.int64()),
                 pa.array(views, type=pa.list_(pa.int64()))],
                names=["id", "key", "node", "whole", "views"],
            )

    return rows.mapInArrow(work, "id long, key long, node long, whole long, views array<long>")


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of nodes that share a cell and are compared first, and the members of large cells."""
    cells = nodes.select("node", "whole", F.posexplode("views").alias("view", "fp"))
    sizes = cells.groupBy("view", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = written(cells.join(sizes, ["view", "fp"]), "views-cells")
    few, many = cells.where(F.col("n") <= CELL_PAIRS), cells.where(F.col("n") > CELL_PAIRS)
    left = few.select("view", "fp", F.col("node").alias("a"))
    pairs = left.join(few.select("view", "fp", F.col("node").alias("b")), ["view", "fp"]).where("a < b").select("a", "b")

    # The bits that most members of a large cell have, then the members nearest to them.
    bits = [F.sum(F.shiftrightunsigned("whole", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    middle = many.groupBy("view", "fp").agg(F.count(F.lit(1)).alias("m"), *bits)
    center = F.lit(0).cast("long")
    for b in range(64):
        center = center.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("m"), F.lit(signed(1 << b))).otherwise(F.lit(0).cast("long")))
    far = F.bit_count(F.col("whole").bitwiseXOR(F.col("center")))
    placed = many.join(middle.select("view", "fp", center.alias("center")), ["view", "fp"])
    order = Window.partitionBy("view", "fp").orderBy("far", "node")
    pivots = placed.select("view", "fp", "node", far.alias("far")).withColumn("at", F.row_number().over(order))
    pivots = written(pivots.where(F.col("at") <= PIVOTS).select("view", "fp", F.col("node").alias("pivot")), "views-pivots")
    stars = many.join(pivots, ["view", "fp"]).where("node <> pivot")
    stars = stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    return pairs.unionByName(stars).distinct(), many.select("view", "fp", "node")


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most of a sample of the texts have, in order of their hashes, and in how many."""
    one_of = max(1, texts.count() // SAMPLED)

    def work(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(text.as_py(), size).view(np.int64))], names=["shingle"])

    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(one_of)) == 0).select("text")
    counted = sample.mapInArrow(work, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = written(counted, "views-frequent")
    least, total = 2, 0
    for n, shingles in sorted(counted.groupBy("n").count().collect(), reverse=True):  # at most a row for each sampled text
        total += shingles
        if total > FREQUENT:
            least = n + 1
            break
    table = counted.where(F.col("n") >= least).toArrow()
    hashes = table.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], table.column("n").to_numpy()[order]


def _prefixes(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(shingle, node, root, n, at) of each text's first shingles, the rare ones first.

    Of a text's n shingles a partner has at least similarity * n, so one of the first
    n - similarity * n + 1 in any order that all texts share; ``at`` is its place.
    """
    shared = share(texts.sparkSession, _frequent(texts, size))

    def work(batches):
        known, often = shared.value
        for batch in batches:
            for node, root, text in zip(*(batch.column(k) for k in range(3))):
                mine = _distinct(text.as_py(), size)
                weight = np.zeros(len(mine), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    weight = np.where(known[at] == mine, often[at], 0)
                n = len(mine)
                first = mine[np.lexsort((mine, weight))][: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64)
                same = [np.full(len(first), x.as_py(), dtype=np.int64) for x in (node, root)]
                columns = [first, *same, np.full(len(first), n, dtype=np.int64), np.arange(len(first), dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "root", "n", "at"])

    return texts.select("node", "root", "text").mapInArrow(work, "shingle long, node long, root long, n long, at long")


def _open_pairs(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """All pairs (a, b) of texts with different roots that can have the similarity.

    A pair that has it shares one of the first shingles of either text, and behind the
    first that they share both have enough left; sizes and places rule out most others.
    The rows of a frequent shingle meet in blocks, each pair of blocks by itself.
    """
    rows = written(_prefixes(texts, size, similarity), "views-prefixes")
    lists = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
    lists = written(lists.where("low < high").select("shingle", F.ceil(F.col("m") / BLOCK_ROWS).alias("blocks")), "views-lists")
    rows = rows.join(lists, "shingle").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    rows = written(rows, "views-blocks")
    names = ("node", "root", "n", "at", "block")
    both = rows.withColumnsRenamed({c: f"{c}_a" for c in names}).join(
        rows.withColumnsRenamed({c: f"{c}_b" for c in names}), ["shingle", "i", "j"]
    )
    both = both.where("root_a < root_b AND (i = j OR block_a <> block_b)")
    # Less than a rounding error, so that no pair on the limit is lost.
    least = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-6)
    both = both.where(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= least)
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _similar(pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least the similarity, by their whole shingle sets."""

    def work(batches):
        known: dict[int, np.ndarray] = {}
        held = 0

        def shingles(node, text):
            nonlocal held
            if node not in known:
                known[node] = _distinct(text.as_py(), size)
                held += known[node].nbytes
                while held > KEPT_BYTES and len(known) > 1:
                    held -= known.pop(next(iter(known))).nbytes
            return known[node]

        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                x, y = shingles(a, text_a), shingles(b, text_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return pairs.mapInArrow(work, "a long, b long")


def _merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` (node, root) with the roots that the links (a, b) of its nodes connect made one."""
    roots = named.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    links = links.join(roots, "a").join(roots.withColumnsRenamed({"a": "b", "root_a": "root_b"}), "b")
    joined = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("joined"))
    return written(named.join(joined, "root", "left").select("node", F.coalesce("joined", "root").alias("root")), "views-named")


def _groups(rows: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, root) of all nodes; links of at least the similarity connect those of one root."""

    def texts_of(asked):
        asked = written(nodes.select("node", "key").join(asked, "node"), "views-asked")
        return written(_chosen(rows.select("key", "text"), asked, ["key"]).drop("key").dropDuplicates(["node"]), "views-texts")

    def linked(pairs, texts):
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return written(_similar(both.select("a", "b", "text_a", "text_b"), size, similarity), "views-links")

    pairs, many = _candidates(nodes)
    pairs = written(pairs, "views-pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    named = nodes.select("node", F.col("node").alias("root"))
    named = _merged(named, linked(pairs, texts_of(asked)))
    # Of large cells that are still several groups all members are searched for the pairs that are left.
    several = many.join(named, "node").groupBy("view", "fp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    several = written(several.where("low < high").select("view", "fp"), "views-several")
    if several.isEmpty():
        return named
    asked = many.join(several, ["view", "fp"]).select("node").distinct().join(named, "node")
    texts = texts_of(asked)
    left = written(_open_pairs(texts, size, similarity), "views-open")
    roots = texts.select("node", "root")
    # One pair of each two groups first; then, of groups that are still two, all.
    for every in (False, True):
        left = left.join(roots.toDF("a", "root_a"), "a").join(roots.toDF("b", "root_b"), "b").where("root_a <> root_b")
        left = written(left, "views-open")
        if left.isEmpty():
            break
        low, high = F.least("root_a", "root_b"), F.greatest("root_a", "root_b")
        one = left.groupBy(low.alias("low"), high.alias("high")).agg(F.min(F.struct(F.xxhash64("a", "b"), "a", "b")).alias("p"))
        links = linked(left.select("a", "b") if every else one.select("p.a", "p.b"), texts.select("node", "text"))
        named = _merged(named, links)
        roots, left = named, left.select("a", "b")
    return named


def mark_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, key (hash of the text), group_id and kept.

    A link is a Jaccard similarity of the distinct ``size``-word shingles (A-Z as lower
    case) of at least ``similarity``, computed from whole texts for every candidate pair;
    groups are what links connect. The row with the smallest id of a group is kept. Texts
    with the same words are one node, so copies cost nothing. Texts without words are
    kept, each by itself. Rows that repeat id and text are all marked alike. Null ids are
    passed over while the group has another. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.col(text_col).cast("binary").alias("text"),
    )
    seen = written(_views(rows, size), "views-rows")
    spoken = seen.where(F.size("views") > 0)
    nodes = spoken.groupBy("node").agg(F.min("id").alias("first"), F.min("key").alias("key"), F.first("whole").alias("whole"),
                                       F.first("views").alias("views"))
    nodes = written(nodes, "views-nodes")
    named = _groups(rows, nodes, size, similarity)
    named = nodes.select("node", "first").join(named, "node")
    groups = named.groupBy("root").agg(F.min("first").alias("group_id"))
    # Copies of one text differ in case only, or are the same row; of those with the
    # smallest id the one with the smallest key stays.
    named = named.join(groups, "root").select("node", "group_id")
    placed = spoken.select("id", "key", "node").join(named, "node")
    lowest = placed.where(F.col("id").eqNullSafe(F.col("group_id"))).groupBy("group_id").agg(F.min("key").alias("kept_key"))
    placed = placed.join(lowest, placed["group_id"].eqNullSafe(lowest["group_id"]), "left").drop(lowest["group_id"])
    kept = F.col("id").eqNullSafe(F.col("group_id")) & (F.col("key") == F.col("kept_key"))
    alone = seen.where(F.size("views") == 0).select("id", "key", F.col("id").alias("group_id"), F.lit(True).alias("kept"))
    return placed.select("id", "key", "group_id", kept.alias("kept")).unionByName(alone)


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    marks = written(mark_groups(docs, size, similarity, id_col, text_col), "views-marks")
    again = marks.where("kept").groupBy("id", "key").count().where("count > 1")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return without(docs, id_col, key, marks.where("NOT kept"), again)
