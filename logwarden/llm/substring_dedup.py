"""Remove passages that an earlier document has: suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import BROADCAST_BYTES, small, written

#: Words of the run that anchors a window; every window has one of its runs as its anchor.
GRAM = 16
#: Words of reference text per automaton, and of document text that one task streams through it.
SHARD_WORDS, STREAM_WORDS = 50_000, 200_000
#: Hashes of words that a task remembers.
CACHE_WORDS = 500_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class WordHashes:
    """64-bit hashes of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def run_hashes(a: np.ndarray, size: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """A hash of each run of ``size`` values, from runs of powers of two."""
    out, have, part, step, power = None, 0, a, 1, np.array([base])
    while True:
        if size & step:
            if out is None:
                out, have = part, step
            else:
                n = len(a) - have - step + 1
                out, have = out[:n] * power + part[have : have + n], have + step
        if step * 2 > size:
            break
        part = part[:-step] * power + part[step:]
        power, step = np.multiply(power, power, dtype=np.uint64), step * 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _extreme(a: np.ndarray, width: int, of) -> np.ndarray:
    """The least (or most) of each ``width`` neighbours."""
    part, step = a, 1
    while step * 2 <= width:
        part, step = of(part[:-step], part[step:]), step * 2
    n = len(a) - width + 1
    return of(part[:n], part[width - step : width - step + n])


def window_anchors(a: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor: the least hash among its runs; and the distinct anchors."""
    if len(a) < window:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    least = _extreme(run_hashes(a, GRAM), window - GRAM + 1, np.minimum).view(np.int64)
    return least, np.unique(least)


class Automaton:
    """Suffix automaton of passages, given in order of their documents.

    A state stands for word sequences with the same ends; ``first`` is the document
    that has them first.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, steps: dict[int, int], link: int, length: int, first: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """Give the shorter sequences of ``q`` that ``p`` leads to a state of their own."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[int], document: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            state = self._state({}, 0, self.length[last] + 1, document)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = state

    def earlier(self, words: list[int], document: int, window: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` covered by windows that an earlier document has.

        Matching statistics: at each word the longest match that ends there, cut to the
        window once it reaches it.
        """
        out: list[list[int]] = []
        state = size = 0
        nexts, link, length, first = self.next, self.link, self.length, self.first
        for at, word in enumerate(words):
            to = nexts[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nexts[state].get(word)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= window:
                while length[link[state]] >= window:
                    state = link[state]
                size = window
                if first[state] < document:
                    if out and out[-1][1] >= at - window + 1:
                        out[-1][1] = at + 1
                    else:
                        out.append([at - window + 1, at + 1])
        return [tuple(x) for x in out]


def _digest(words: list[bytes], gone: list[tuple[int, int]]) -> tuple[int, str]:
    keep = np.ones(len(words), dtype=bool)
    for a, b in gone:
        keep[a:b] = False
    kept = words if keep.all() else [w for w, k in zip(words, keep) if k]
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """Per row: id, key, number of words, digest of all words, and distinct anchors."""

    def work(batches):
        hashes = WordHashes()
        for batch in batches:
            sizes, digests, anchors = [], [], []
            for text in batch.column(2):
                words = (text.as_py() or b"").split()
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                anchors.append(window_anchors(hashes.of(words), window)[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.binary()),
                 pa.array(anchors, type=pa.list_(pa.int64()))],
                names=["id", "key", "n_words", "sha", "anchors"],
            )

    return docs.mapInArrow(work, "id long, key long, n_words long, sha binary, anchors array<long>")


def _marked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(id, key, words, anchors, firsts, role) of each row, anchors sorted."""
    for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
        i, key, text, anchors, firsts, role = row[:6]
        anchors = np.array(anchors.as_py(), dtype=np.int64)
        order = np.argsort(anchors)
        yield (i.as_py(), key.as_py(), (text.as_py() or b"").split(), anchors[order],
               np.array(firsts.as_py(), dtype=np.int64)[order], role.as_py(), *[x.as_py() for x in row[6:]])


def _first_of(least: np.ndarray, anchors: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have a shared anchor, and the first document that has it."""
    at = np.minimum(np.searchsorted(anchors, least), len(anchors) - 1)
    return anchors[at] == least, firsts[at]


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(a, b, id) of the windows with a shared anchor; a and b hash the window's words.

    Later copies of a whole document add nothing but that all its windows are shared,
    which the first copy says for them.
    """

    def work(batches):
        hashes = WordHashes()
        for batch in batches:
            for i, _, words, anchors, firsts, role in _marked(batch):
                if role == 2:
                    continue
                values = hashes.of(words)
                shared, _ = _first_of(window_anchors(values, window)[0], anchors, firsts)
                a = run_hashes(values, window)[shared].view(np.int64)
                b = (run_hashes(values, window, _BASES[1])[shared] >> np.uint64(32)).astype(np.int64)
                for owner in (i, np.iinfo(np.int64).max) if role == 1 else (i,):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a), pa.array(b), pa.array(np.full(len(a), owner, dtype=np.int64))], names=["a", "b", "id"]
                    )

    return texts.mapInArrow(work, "a long, b long, id long")


def _runs(mask: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, behind the last, bucket) of runs of marked windows of one bucket."""
    at = np.flatnonzero(mask)
    if len(at):
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(bucket[at]) != 0)) + 1
        for part in np.split(at, cut):
            yield int(part[0]), int(part[-1]) + 1, int(bucket[part[0]])


def _bucket(firsts: np.ndarray, buckets: int) -> np.ndarray:
    mixed = firsts.astype(np.uint64) * _BASES[0]
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


_PASSAGES = "bucket long, id long, key long, start long, n long, words binary"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    types = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, types)], names=["bucket", "id", "key", "start", "n", "words"]
    )


def _references(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """Passages of the windows that a document has first (``mine``: their hashes)."""

    def work(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for i, key, words, anchors, firsts, _, mine in _marked(batch):
                values = hashes.of(words)
                shared, owner = _first_of(window_anchors(values, window)[0], anchors, firsts)
                first = shared & np.isin(run_hashes(values, window).view(np.int64), np.array(mine, dtype=np.int64))
                for a, b, bucket in _runs(first, _bucket(owner, buckets)):
                    rows.append((bucket, i, key, a, b - a + window - 1, b" ".join(words[a : b + window - 1])))
            yield _emit(rows)

    return texts.mapInArrow(work, _PASSAGES)


def _regions(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """Passages of the windows whose anchor an earlier document has, to be matched."""

    def work(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for i, key, words, anchors, firsts, _ in _marked(batch):
                values = hashes.of(words)
                shared, owner = _first_of(window_anchors(values, window)[0], anchors, firsts)
                for a, b, bucket in _runs(shared & (owner < i), _bucket(owner, buckets)):
                    rows.append((bucket, i, key, a, b - a + window - 1, b" ".join(words[a : b + window - 1])))
            yield _emit(rows)

    return texts.mapInArrow(work, _PASSAGES)


def _match(references: DataFrame, regions: DataFrame, window: int) -> DataFrame:
    """(id, key, start, stop) of the spans to remove.

    Each shard of references meets the regions of its bucket in as many tasks as these
    need; a task builds the automaton of the shard and streams its regions through it.
    """
    sizes = regions.groupBy("bucket").agg(F.ceil(F.sum("n") / STREAM_WORDS).alias("salts"))
    sizes = written(sizes, "substring-salts")
    asked = regions.join(sizes, "bucket").withColumn("salt", F.pmod(F.xxhash64("id", "key", "start"), F.col("salts")))
    asked = asked.drop("salts", "n")
    shards = references.join(sizes, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    shards = shards.select("bucket", "salt", "id", "words")

    def work(known: pa.Table, asked: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        automaton = Automaton()
        passages = sorted(zip(known.column("id").to_pylist(), known.column("words").to_pylist()))
        for document, words in passages:
            automaton.add([numbers.setdefault(w, len(numbers)) for w in words.split()], document)
        out: list[tuple[int, int, int, int]] = []
        for i, key, start, words in zip(*(asked.column(c).to_pylist() for c in ("id", "key", "start", "words"))):
            found = automaton.earlier([numbers.get(w, -1) for w in words.split()], i, window)
            out += [(i, key, start + a, start + b) for a, b in found]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(c, type=pa.int64()) for n, c in zip(("id", "key", "start", "stop"), columns)})

    grouped = shards.groupBy("bucket", "salt").cogroup(asked.groupBy("bucket", "salt"))
    return grouped.applyInArrow(work, "id long, key long, start long, stop long")


def _finish(texts: DataFrame) -> DataFrame:
    """n_removed and digest of the rows that lose words (``gone``: their spans)."""

    def work(batches):
        for batch in batches:
            rows = []
            for i, key, text, gone in zip(*(batch.column(k) for k in range(4))):
                spans = [(g["start"], g["stop"]) for g in gone.as_py()]
                rows.append((i.as_py(), key.as_py(), *_digest((text.as_py() or b"").split(), spans)))
            columns = list(zip(*rows)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types)], names=["id", "key", "n_removed", "kept"]
            )

    return texts.mapInArrow(work, "id long, key long, n_removed long, kept string")


def _chosen(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``docs`` that ``keys`` names, without a shuffle of the others where keys are few."""
    names = keys.select(*on).distinct()
    if names.count() * 40 <= BROADCAST_BYTES:
        docs = docs.join(F.broadcast(names), on, "left_semi")
    return docs.join(keys, on)


def repeated_spans(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text"):
    """Base rows (id, key, n_words, sha), texts with shared anchors, and the spans to remove.

    Only windows whose anchor occurs in two documents are hashed whole; those found in two
    become the reference, each from the document that has it first, so that copies don't
    add to it. Automata of the reference then decide word by word what is removed.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM} words")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.col(text_col).cast("binary").alias("text"),
    )
    base = written(_scan(rows, window), "substring-base")
    known = base.where("id IS NOT NULL").select("id", "key", "sha", "anchors")
    anchors = known.select("id", "key", F.explode("anchors").alias("anchor")).distinct()
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    shared = written(shared.select("anchor", "first"), "substring-anchors")
    buckets = max(8, -(-shared.count() * (50 - GRAM) // (2 * SHARD_WORDS)))
    marks = anchors.join(shared, "anchor").groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "first")).alias("m"))
    # Written, so that the join has a shuffle on either side and a group of any size can be split.
    copies = known.groupBy("sha").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    copies = written(copies, "substring-copies")
    roles = known.join(copies, "sha").select("id", "key", F.when(F.col("id") == F.col("low"), 1).otherwise(2).alias("role"))
    marks = marks.join(roles.distinct(), ["id", "key"], "left")
    marks = marks.select("id", "key", "m.anchor", "m.first", F.coalesce("role", F.lit(0)).alias("role"))
    marks = written(marks, "substring-marks")
    texts = written(_chosen(rows, marks, ["id", "key"]).select("id", "key", "text", "anchor", "first", "role"), "substring-texts")

    windows = _windows(texts, window).groupBy("a", "b").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    firsts = written(windows.where("id < last").groupBy("id").agg(F.collect_list("a").alias("mine")), "substring-firsts")
    references = _references(_chosen(texts, firsts, ["id"]).select("id", "key", "text", "anchor", "first", "role", "mine"), window, buckets)
    regions = written(_regions(texts, window, buckets), "substring-regions")
    return base, texts, _match(references, regions, window)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed and kept_sha256 (kept words joined by one space).

    Words are runs without white space of ASCII. A word is removed if a window of
    ``window`` words that covers it occurs in a document with a smaller id; windows are
    judged on the input. Null texts have no words. Rows with a null id keep theirs and
    remove none; rows that share an id don't remove each other's. Other columns are not
    read. An empty table gives an empty result.
    """
    base, texts, spans = repeated_spans(docs, window, id_col, text_col)
    gone = written(spans, "substring-spans").groupBy("id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    gone = written(gone, "substring-gone")
    lost = _finish(_chosen(texts, gone, ["id", "key"]).select("id", "key", "text", "gone")).dropDuplicates(["id", "key"])
    out = base.select("id", "key", "n_words", "sha").join(small(written(lost, "substring-lost"), 120), ["id", "key"], "left")
    return out.select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
