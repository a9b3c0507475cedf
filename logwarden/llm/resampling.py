"""Importance resampling towards a target distribution of hashed n-grams.

Documents are drawn by the log ratio of how often their n-grams' buckets occur in target
texts and in the corpus, with Gumbel noise from the id, so that a draw of the highest
scores is a sample without replacement. Each batch of texts interns its n-grams in an
open-addressed table of NumPy arrays: hashes lead to slots, bytes are compared before a
slot is shared, each slot holds its n-gram's bucket and count, and the slot of every
occurrence gathers the gains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import private, share, written
from logwarden.operators.ordering import numbered

BUCKETS = 10_000
#: Documents with fewer words are never drawn.
MIN_WORDS = 20
#: Bytes of text that are hashed together; a longer text is hashed alone.
BATCH_BYTES = 2 << 20
#: Bytes of an n-gram that are hashed by whole arrays; longer ones are hashed one by one.
LANES = 3

_U = np.uint64
#: Fixed values of XXH64.
_P1, _P2, _P3 = _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_P4, _P5 = _U(0x85EBCA77C2B2AE63), _U(0x27D4EB2F165667C5)

#: Each byte in lower case if it belongs to a word, else a space: 0-9, A-Z, a-z and all above 127.
_FOLD = np.full(256, 32, dtype=np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def xxh64(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lanes): XXH64 with seed 0 of each slice of ``buffer`` and its first 24 bytes as three words.

    Slices of up to 31 bytes take part in array steps; longer ones are hashed one by one.
    ``buffer`` needs 32 bytes more than its last slice.
    """
    words = np.lib.stride_tricks.sliding_window_view(buffer, 8)
    n = sizes.astype(_U)
    with np.errstate(over="ignore"):
        h = _P5 + n
        lanes = np.zeros((LANES + 1, len(starts)), dtype=_U)
        for k in range(LANES + 1):
            here = np.flatnonzero(sizes > 8 * k)
            lane = np.ascontiguousarray(words[starts[here] + 8 * k]).view("<u8").ravel().astype(_U)
            left = np.minimum(sizes[here] - 8 * k, 8)
            lane &= np.where(left == 8, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (left * 8).astype(_U)) - _U(1))
            lanes[k, here] = lane
            full = here[left == 8]
            mixed = _rotated(lanes[k, full] * _P2, 31) * _P1
            h[full] = _rotated(h[full] ^ mixed, 27) * _P1 + _P4
        tail = sizes % 8
        rest = lanes[np.minimum(sizes // 8, LANES), np.arange(len(starts))]
        four = np.flatnonzero(tail >= 4)
        h[four] = _rotated(h[four] ^ ((rest[four] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        for k in range(3):
            here = np.flatnonzero(tail % 4 > k)
            at = (np.where(tail[here] >= 4, 32, 0) + 8 * k).astype(_U)
            h[here] = _rotated(h[here] ^ (((rest[here] >> at) & _U(0xFF)) * _P5), 11) * _P1
        h ^= h >> _U(33)
        h *= _P2
        h ^= h >> _U(29)
        h *= _P3
        h ^= h >> _U(32)
    for i in np.flatnonzero(sizes > 31).tolist():
        h[i] = xxhash.xxh64_intdigest(buffer[starts[i] : starts[i] + sizes[i]].tobytes())
    return h, lanes


def intern(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each slice, first slice of each slot): equal slices share a slot, others never do.

    All slices probe the table at once. A free place goes to one of those that ask for it;
    the others there, and those that find a place taken, stay if hash, size and bytes are
    the owner's and ask for the next place if not.
    """
    total = len(starts)
    hashes, lanes = xxh64(buffer, starts, sizes)
    places = 1 << max(4, int(2 * total).bit_length())
    owner = np.full(places, -1, dtype=np.int64)
    at = (hashes & _U(places - 1)).astype(np.int64)
    found = np.empty(total, dtype=np.int64)
    asking = np.arange(total)
    while len(asking):
        spot = at[asking]
        free = owner[spot] < 0
        owner[spot[free][::-1]] = asking[free][::-1]
        held = owner[spot]
        same = (hashes[held] == hashes[asking]) & (sizes[held] == sizes[asking]) & (lanes[:, held] == lanes[:, asking]).all(0)
        for i in np.flatnonzero(same & (sizes[asking] > 8 * (LANES + 1))).tolist():
            a, b, n = starts[held[i]], starts[asking[i]], sizes[held[i]]
            same[i] = a == b or np.array_equal(buffer[a : a + n], buffer[b : b + n])
        found[asking[same]] = spot[same]
        asking = asking[~same]
        at[asking] = (at[asking] + 1) & (places - 1)
    taken = np.flatnonzero(owner >= 0)
    slots = np.empty(places, dtype=np.int64)
    slots[taken] = np.arange(len(taken))
    return slots[found], owner[taken]


class Grams:
    """All n-grams of some texts: per occurrence its document and slot, per slot bucket and count."""

    def __init__(self, texts: list[bytes], size: int, buckets: int):
        raw = np.frombuffer(b" ".join([*texts, b" "]) + b" " * 40, dtype=np.uint8)
        folded = _FOLD[raw]
        word = folded != 32
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
        begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(bounds, begins, side="right")
        self.words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        # Words one space apart: word bytes and the byte behind each word stay.
        keep = word.copy()
        keep[stops] = True
        packed = np.concatenate([folded[keep], np.full(40, 32, dtype=np.uint8)])
        lengths = stops - begins
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        count = len(begins)
        at, to, of = [], [], []
        for n in range(1, size + 1):
            first = np.flatnonzero(doc[: max(count - n + 1, 0)] == doc[n - 1 :]) if count >= n else np.empty(0, dtype=np.int64)
            at.append(starts[first])
            to.append(ends[first + n - 1])
            of.append(doc[first])
        starts, ends, self.doc = np.concatenate(at), np.concatenate(to), np.concatenate(of)
        self.slot, owners = intern(packed, starts, ends - starts)
        cut, packed = zip(starts[owners].tolist(), ends[owners].tolist()), packed.tobytes()
        self.bucket = np.fromiter((zlib.crc32(packed[a:b]) % buckets for a, b in cut), dtype=np.int64, count=len(owners))
        self.count = np.bincount(self.slot, minlength=len(owners))


def _runs(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of a bounded size, each with its offset."""
    start, held, run = 0, 0, []
    for k, x in enumerate(column):
        text = x.as_py() or b""
        if run and held + len(text) > limit:
            yield start, run
            start, held, run = k, 0, []
        run.append(text)
        held += len(text)
    if run:
        yield start, run


def bucket_counts(texts: DataFrame, text_col: str = "text", size: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall in each bucket; empty buckets are absent."""

    def work(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, run in _runs(batch.column(0)):
                grams = Grams(run, size, buckets)
                np.add.at(total, grams.bucket, grams.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("binary")).mapInArrow(work, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln of the smoothed ratio of its shares in the target and in the corpus).

    Both sides come as :func:`bucket_counts`: at most ``buckets`` rows each reach the driver.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((corpus, s), (target, t)):
        for bucket, n in counts.collect():
            into[bucket] = n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(
    docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", size: int = 1
) -> DataFrame:
    """One row per input row: id, n_words, n_features, weight (floored mean gain; 0 without features)."""
    spark = docs.sparkSession
    shared = share(spark, gain)  # 8 bytes a bucket

    def work(batches):
        of = shared.value
        names = ["id", "n_words", "n_features", "weight"]
        for batch in batches:
            for start, run in _runs(batch.column(1)):
                grams = Grams(run, size, len(of))
                n = np.bincount(grams.doc, minlength=len(run)).astype(np.int64)
                total = np.zeros(len(run), dtype=np.int64)
                np.add.at(total, grams.doc, of[grams.bucket][grams.slot])
                ids = batch.column(0).slice(start, len(run))
                columns = [ids, *(pa.array(c) for c in (grams.words, n, total // np.maximum(n, 1)))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(work, "id long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """floor(1000 times a standard Gumbel number), fixed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int) -> DataFrame:
    """Add ``rank``, 1, 2, 3... by falling score and rising id of the drawn rows, null elsewhere.

    Of the N rows with ``eligible`` the floor(percent * N / 100) highest are drawn. Scores
    are whole numbers within some ten thousands of each other, so counts per score
    show where the draw ends; rows above are placed in ranges and sorted there.
    ``scored`` is read three times and should be written.
    """
    able = scored.where("eligible")
    steps = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in steps) // 100
    cutoff, reached = None, 0
    for score, n in steps:
        if reached >= wanted:
            break
        cutoff, reached = score, reached + n
    none = F.lit(None).cast("long")
    if cutoff is None:
        return scored.withColumn("rank", none)
    inside = F.coalesce(F.col("eligible") & (F.col("score") >= cutoff), F.lit(False))
    at = private("at")
    placed = numbered(scored.where(inside), F.desc("score"), F.asc("id"), F.asc("n_features"), F.asc("row"), name=at)
    ranked = placed.withColumn("rank", F.when(F.col(at) < wanted, F.col(at) + 1)).drop(at)
    return ranked.unionByName(scored.where(~inside).withColumn("rank", none))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, size: int = 1, buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_features, weight, score and rank (null where it isn't drawn).

    A null text and one without words have no features, weight 0, and are not drawn where
    ``min_words`` is positive. Repeated rows count and are ranked each; rows that tie in
    score and id follow n_features, equal ones stand in any order. Null ids share the noise
    of the text ``null`` and come before others in ties. A long text is one run of its own
    and is hashed whole. An empty corpus gives an empty result, an empty target makes all
    target counts 0. Other columns are not read.
    """
    corpus = bucket_counts(docs, text_col, size, buckets)
    gain = gains(corpus, bucket_counts(target, target_col, size, buckets), buckets)
    rows = weights(docs, gain, id_col, text_col, size)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    rows = rows.select("id", "n_features", "weight", "score", (F.col("n_words") >= min_words).alias("eligible"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    return drawn(rows, percent).select("id", "n_features", "weight", "score", "rank")
