"""SimHash near-duplicates by the general pigeonhole principle."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import small, without, written

BITS = 64
#: Fingerprints of one cell that are compared with each other; fuller cells are searched by neighbours.
CELL_LIMIT = 64
#: Cost of one probe and of one candidate, as the allocation weighs them.
PROBE_COST, CANDIDATE_COST = 1.0, 0.5
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; fewer words make one run."""
    words = text.split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    pairs = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    return np.array([digest(joined[a:b], 42) for a, b in pairs], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(
    docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None
) -> DataFrame:
    """One row per input row: id and fp, the 64-bit SimHash of its word shingles as a long, and ``key`` (a long), if given.

    A-Z count as lower case. Null and empty texts have fingerprint 0.
    """
    more = [] if key is None else ["key"]

    def work(batches):
        for batch in batches:
            values = [signed(majority(shingle_hashes((x.as_py() or b"").lower(), size))) for x in batch.column(1)]
            columns = [batch.column(0), pa.array(values, type=pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", *more])

    given = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")]
    given += [] if key is None else [key.cast("long").alias("key")]
    return docs.select(*given).mapInArrow(work, ", ".join(f"{c} long" for c in ("id", "fp", *more)))


def joint_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each two bits are set together: 64 x 64 sums over all fingerprints."""

    def work(batches):
        total = np.zeros((BITS, BITS), dtype=np.int64)
        rows = 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            for at in range(0, len(values), BLOCK):
                bits = np.unpackbits(values[at : at + BLOCK], axis=1)[:, ::-1].astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
                rows += len(bits)
        cells = np.append(total.ravel(), rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    sums = fps.select("fp").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for cell, n in sums.collect():  # 4,097 rows whatever the input
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def partitions(rows: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of equal size with correlated bits together."""
    p = np.diag(joint) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs(joint / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (sum(correlation[b, c] for c in left if c != b), -b))]
        left.remove(group[0])
        while len(group) < size:
            bit = max(left, key=lambda b: (sum(correlation[b, c] for c in group), -b))
            group.append(bit)
            left.remove(bit)
        out.append(sorted(group))
    return out


def ball(bits: list[int], radius: int) -> list[int]:
    """Masks that flip at most ``radius`` of the bits."""
    return [signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(bits, r)]


def allocate(rows: int, joint: np.ndarray, groups: list[list[int]], squares: list[float], radius: int):
    """Thresholds of the partitions and their estimated cost, by dynamic programming.

    Two fingerprints that differ in at most ``radius`` bits differ in at most t bits of
    some partition if the thresholds t + 1 add up to ``radius`` + 1; -1 leaves a
    partition out. ``squares`` has the pairs that agree in a partition; how many more
    agree but for a few bits is estimated from how often each bit differs.
    """
    p = np.diag(joint) / max(rows, 1)
    differ = np.clip(2 * p * (1 - p), 0, 0.5)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, square in zip(groups, squares):
        odds = differ[bits] / (1 - differ[bits])
        shares = np.zeros(radius + 2)
        shares[0] = 1
        for o in odds:
            shares[1:] += o * shares[:-1]
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units in range(radius + 2 - used):
                more = 0.0
                if units:
                    probes = rows * len(ball(bits, units - 1))
                    more = PROBE_COST * probes + CANDIDATE_COST * square * shares[:units].sum()
                key = used + units
                if key not in step or cost + more < step[key][0]:
                    step[key] = (cost + more, [*chosen, units - 1])
        best = step
    return best[radius + 1]


def _masked(bits: list[int]) -> Column:
    return F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))


def plan(fps: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """Bits and threshold of each partition that is probed, for distinct fingerprints ``fps``."""
    rows, joint = joint_counts(fps)
    layouts = {m: partitions(rows, joint, m) for m in range(1, radius + 3)}
    keyed = [(m, k, bits) for m, groups in layouts.items() for k, bits in enumerate(groups)]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _masked(b).alias("v")) for i, (_, _, b) in enumerate(keyed)]))
    counted = fps.select(cells.alias("c")).select("c.i", "c.v").groupBy("i", "v").count()
    squares = dict(counted.groupBy("i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect())
    options = []
    for m, groups in layouts.items():
        mine = [squares.get(i, 0.0) for i, (n, _, _) in enumerate(keyed) if n == m]
        cost, thresholds = allocate(rows, joint, groups, mine, radius)
        options.append((cost, m, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(options)[2]


def _flips(masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(x) for x in masks]), lambda m: F.col("fp").bitwiseXOR(m)))


def links(fps: DataFrame, radius: int, chosen: list[tuple[list[int], int]] | None = None, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Pairs (a, b) that connect all distinct fingerprints within ``radius`` bits.

    Fingerprints are looked up by the bits of each partition, with up to its threshold of
    them flipped, and pairs that meet are compared. Where a cell holds more than
    ``cell_limit`` of them, its fingerprints are instead looked up by all values within
    half the radius, where those that meet are within ``radius`` by construction; they
    are linked to one of them, so a crowded cell gives no more links than it has rows.
    """
    chosen = plan(fps, radius) if chosen is None else chosen

    def places(mask_lists) -> DataFrame:
        def place(i, bits):
            return lambda mask: F.struct(F.lit(i).alias("i"), _masked(bits).bitwiseXOR(mask).alias("v"))

        values = [
            F.transform(F.array(*[F.lit(x) for x in masks]), place(i, bits))
            for i, ((bits, _), masks) in enumerate(zip(chosen, mask_lists))
        ]
        return fps.select("fp", F.explode(F.concat(*values)).alias("c")).select("fp", "c.i", "c.v")

    entries = places([[0]] * len(chosen))
    exact = all(threshold == 0 for _, threshold in chosen)
    asked = entries if exact else places([ball(bits, threshold) for bits, threshold in chosen])
    full = written(entries.groupBy("i", "v").count().where(F.col("count") > cell_limit).select("i", "v"), "simhash-full")
    crowded = None
    if not full.isEmpty():
        full = small(full, 48)
        crowded = asked.join(full, ["i", "v"], "left_semi").select("fp")
        if not exact:
            crowded = crowded.unionByName(entries.join(full, ["i", "v"], "left_semi").select("fp"))
        crowded = crowded.distinct()
        entries = entries.join(full, ["i", "v"], "left_anti")
        asked = entries if exact else asked.join(full, ["i", "v"], "left_anti")
    left, right = asked.withColumnRenamed("fp", "a"), entries.withColumnRenamed("fp", "b")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = left.join(right, ["i", "v"]).where((F.col("a") < F.col("b")) & (differ <= radius)).select("a", "b")
    if crowded is None:
        return found.distinct()
    every = list(range(BITS))
    far, close = ball(every, (radius + 1) // 2), ball(every, radius // 2)
    around = crowded.select("fp", _flips(far).alias("v"))
    meet = (around if len(far) == len(close) else crowded.select("fp", _flips(close).alias("v")))
    meet = meet.groupBy("v").agg(F.min("fp").alias("a"))
    stars = around.join(meet, "v").where("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    return found.unionByName(stars).distinct()


def components(edges: DataFrame, max_steps: int = 100) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reached.

    Alternates two contractions: larger neighbours of a node are linked to its smallest
    neighbour, then smaller ones. Each step is written; links only ever lead to smaller
    nodes, until each node has one link, to its root.
    """
    links = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    state = None
    for _ in range(max_steps):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Smallest neighbours are written, so that the joins have a shuffle on either side
        # (or none) and a node with any number of links can be split.
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        low = written(low, "components-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = written(large, "components-large")
        low = written(large.groupBy("u").agg(F.min("v").alias("low")), "components-low")
        small = large.join(low, "u")
        small = small.select("u", F.col("low").alias("v")).unionByName(
            small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        )
        links = written(small.distinct(), "components")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links did not settle in {max_steps} steps")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _component_ids(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints of ``rows`` (id, fp); root is the component's smallest fingerprint."""
    firsts = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = components(links(firsts.select("fp"), radius))
    named = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, fp and component_id, the smallest id it is linked to.

    Rows of one fingerprint are searched as one, so copies cost nothing. Null ids are
    passed over as component ids while the component has another. Null and empty texts
    share fingerprint 0. An empty table gives an empty result.
    """
    rows = written(fingerprints(docs, size, id_col, text_col), "simhash-rows")
    return rows.join(_component_ids(rows, radius), "fp").select("id", "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns.

    The row with the smallest id of a component stays; of several with that id the one whose
    text has the smallest hash, and of rows that repeat id and text one. Null ids are passed
    over while the component has another. Null and empty texts share fingerprint 0, so one of
    them stays. An empty table gives an empty result.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = written(fingerprints(docs, size, id_col, text_col, key), "simhash-rows")
    placed = written(rows.join(_component_ids(rows, radius), "fp").select("id", "key", "root", "component_id"), "simhash-placed")
    own = F.col("id").eqNullSafe(F.col("component_id"))
    kept = placed.where(own).groupBy("root").agg(F.min("key").alias("kept_key"))
    stays = own & (F.col("key") == F.col("kept_key"))
    marks = written(placed.join(kept, "root").select("id", "key", stays.alias("kept")), "simhash-marks")
    again = marks.where("kept").groupBy("id", "key").count().where("count > 1")
    return without(docs, id_col, key, marks.where("NOT kept"), again)
