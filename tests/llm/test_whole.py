"""The whole job where many rows meet: large families, shared passages, many values, hot keys."""

import hashlib
import random

import pytest

from logwarden.llm import line_dedup, simhash_views
from tests.llm.test_methods import TEXT, roots


def near_groups(rows):
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return roots(sets, near)


def drifting_family(n):
    """Each text replaces a few words of the one before, so that only neighbours are similar."""
    words = [f"w{k}" for k in range(120)]
    for i in range(n):
        words = [*words[2:], f"n{i}a", f"n{i}b"]
        yield " ".join(words)


def shared_passage(n):
    """Unrelated texts with one long passage, and a near copy of every tenth of them."""
    passage = " ".join(f"p{k}" for k in range(150))
    for i in range(n):
        own = [f"d{i}x{k}" for k in range(35)]
        yield f"{passage} {' '.join(own)}"
        if i % 5 == 0:
            own[8] = own[20] = own[30] = "other"
            yield f"{passage} {' '.join(own)}"


@pytest.mark.parametrize("made,block", [(drifting_family, 7), (shared_passage, 256)])
def test_near_copies_of_large_cells(spark, monkeypatch, made, block):
    random.seed(11)
    monkeypatch.setattr(simhash_views, "BLOCK_ROWS", block, raising=False)
    texts = list(made(300))
    random.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["id"]: r["group_id"] for r in simhash_views.mark_groups(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == near_groups(rows)


@pytest.mark.parametrize("n", [100, 12_000])
def test_lines_with_many_values_at_every_size(spark, n):
    random.seed(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    values = [a + b + c for a in letters for b in letters[:5] for c in letters[:4]][:200]
    line = "Posted in the {} section by {} who also edits the {} pages here"
    rows = [(i, f"{line.format(*random.choices(values, k=3))}\nown words of {i}") for i in range(n)]
    rows += [(n + i, "The same words in just four documents") for i in range(4)]
    got = line_dedup.remove_recurring_lines(spark.createDataFrame(rows, TEXT)).collect()
    assert all(r["n_removed"] >= 1 for r in got)


def test_numeric_rows_stay_unless_they_recur(spark):
    rows = [(i, f"{i} {i + 7} {3 * i}\n{i}.5 total {i} {i}\nsee the page {i} of this\nCall 555 1234 99") for i in range(1, 9)]
    got = line_dedup.remove_recurring_lines(spark.createDataFrame(rows, TEXT)).collect()
    kept = {i: "\n".join(t.split("\n")[:2]) for i, t in rows}
    assert all(r["kept_sha256"] == hashlib.sha256(kept[r["id"]].encode()).hexdigest() for r in got)


def test_lines_of_one_document_count_once(spark):
    rows = [(1, "\n".join(f"a b c red {x} p q" for x in ("k", "l", "m"))), (2, "a b c blue n p q"), (3, "a b c green o p q")]
    got = {r["id"]: r["n_removed"] for r in line_dedup.remove_recurring_lines(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == {1: 3, 2: 1, 3: 1}
