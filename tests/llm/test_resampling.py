"""Importance resampling against a plain computation."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logwarden.llm import resampling

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, size):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, size + 1) for i in range(len(w) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def plain(docs, target, percent, size, buckets, min_words):
    s = Counter(bucket(g, buckets) for _, t in docs for g in grams(t, size))
    t = Counter(bucket(g, buckets) for x in target for g in grams(x, size))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows, able = [], []
    for i, text in docs:
        found = [bucket(g, buckets) for g in grams(text, size)]
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        row = [i, len(found), weight, score, None]
        rows.append(row)
        if len(words(text)) >= min_words:
            able.append(row)
    able.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return sorted(map(repr, map(tuple, rows)))


def docs_of(n):
    base = "The quick-brown Fox's 42 jumps über straße naïve 中文 a\x00b A.B"
    out = [(k, " ".join(base.split()[(k * 7 + j * j) % 9] for j in range(k % 40))) for k in range(n)]
    return out + [(None, None), (None, base * 9), (5, ""), (3, base * 4), (3, base * 4), (n, "x" * 90 + " " + "x" * 91), (n + 1, "word " * 400_000)]


def test_against_plain(spark):
    docs, target = docs_of(150), ["the fox jumps", "straße 中文 THE", None]
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, rank string, score int, id int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for size, percent, least in ((1, 10, 20), (3, 40, 2)):
        got = resampling.resample(df.repartition(5), goal, percent, size=size, buckets=50, min_words=least).collect()
        assert sorted(map(repr, map(tuple, got))) == plain(docs, target, percent, size, 50, least)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 30), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    got = {r["id"]: r for r in resampling.resample(some, none, percent=100).collect()}
    assert got[1]["rank"] == 1 and got[2]["rank"] is None and got[2]["weight"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=70), min_size=1, max_size=40))
def test_hashes_and_slots(slices):
    slices += slices[::2]
    sizes = np.array([len(s) for s in slices])
    buffer = np.frombuffer(b"".join(slices) + b"\0" * 40, dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    hashes, _ = resampling.xxh64(buffer, starts, sizes)
    assert [int(h) for h in hashes] == [xxhash.xxh64_intdigest(s) for s in slices]
    slot, owner = resampling.intern(buffer, starts, sizes)
    assert len(owner) == len(set(slices))
    assert all(slices[owner[k]] == s for k, s in zip(slot, slices))


def test_colliding_hashes_keep_apart(monkeypatch):
    slices = [b"a", b"b", b"a", b"c" * 50, b"c" * 50, b"c" * 49 + b"d"]
    sizes = np.array([len(s) for s in slices])
    buffer = np.frombuffer(b"".join(slices) + b"\0" * 40, dtype=np.uint8)
    real = resampling.xxh64
    monkeypatch.setattr(resampling, "xxh64", lambda *a: (np.full(len(slices), 7, dtype=np.uint64), real(*a)[1]))
    slot, owner = resampling.intern(buffer, np.cumsum(sizes) - sizes, sizes)
    assert len(owner) == 4 and slot[0] == slot[2] and slot[3] == slot[4]
