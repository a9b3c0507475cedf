"""Drop lines whose template recurs across documents, by a log-template tree."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import small, written
from logwarden.llm.substring_dedup import _chosen

#: Leading tokens that, after the token count, lead to a leaf of the tree; a line without more is taken as it is.
DEPTH = 3
#: A template recurs in at least so many documents.
MIN_DOCS = 3
#: Of the tokens behind its path a template keeps at least this share, and this many unless it keeps
#: all; those that hold a digit are none of them. The path is the leaf's, so it says nothing.
CONSTANT, MIN_KEPT = 0.5, 2
#: Share of the documents of a leaf from which on a token is a constant, whatever the leaf's size.
COMMON = 0.1
#: Tokens that a task hands on at once.
BATCH_TOKENS = 50_000
#: What stands for a token that holds a digit.
FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def tokens_of(line: bytes, depth: int = DEPTH, constant: float = CONSTANT) -> tuple[list[bytes], bool]:
    """Tokens of a line, those that hold digits generalised, and whether the line is taken as it is.

    As it is, without a field, goes a line of at most ``depth`` tokens, and one whose other
    tokens are less than ``constant`` of all.
    """
    tokens = line.split()
    if len(tokens) <= depth:
        return [b"=" + t for t in tokens], True
    if _DIGIT.search(line):
        shown = [FIELD if _DIGIT.search(t) else t for t in tokens]
        if len(tokens) - shown.count(FIELD) < constant * len(tokens):
            return [b"=" + t for t in tokens], True
        return shown, False
    return tokens, False


def place(line: bytes, depth: int = DEPTH, constant: float = CONSTANT) -> tuple[int, int] | None:
    """(leaf, line): hashes of the path to the line's leaf and of its generalised tokens.

    A line that is taken as it is has a leaf of its own; a blank line has none.
    """
    tokens, whole = tokens_of(line, depth, constant)
    if not tokens:
        return None
    path = b"%d " % len(tokens) + b" ".join(tokens if whole else tokens[:depth])
    digest = xxhash.xxh64_intdigest
    return _signed(digest(path)), _signed(digest(b" ".join(tokens)))


def _lines(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.split(b"\n")


def _scan(rows: DataFrame, depth: int, constant: float) -> DataFrame:
    """Per row: id, key, number of lines, digest of the text, and its distinct (leaf, line)."""

    def work(batches):
        for batch in batches:
            out = []
            for i, key, text in zip(*(batch.column(k) for k in range(3))):
                lines = _lines(text.as_py())
                places = {p for p in (place(x, depth, constant) for x in lines) if p}
                shown = hashlib.sha256(b"\n".join(lines)).digest()
                out.append((i.as_py(), key.as_py(), len(lines), shown, [{"leaf": a, "line": b} for a, b in places]))
            columns = list(zip(*out)) or [[]] * 5
            kind = pa.list_(pa.struct([("leaf", pa.int64()), ("line", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), kind]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types)], names=["id", "key", "n_lines", "sha", "places"]
            )

    return rows.mapInArrow(work, "id long, key long, n_lines long, sha binary, places array<struct<leaf:long,line:long>>")


def _tokens(texts: DataFrame, depth: int, constant: float) -> DataFrame:
    """(leaf, line, docs, pos, token) of the lines that ``wanted`` lists for a text, from behind the path on.

    A line without such tokens has one row, with position -1.
    """

    names = ["leaf", "line", "docs", "pos", "token"]

    def batch_of(rows: list[tuple[int, int, int, list[int], int]]) -> pa.RecordBatch:
        sizes = [len(r[3]) for r in rows]
        columns = [np.repeat(np.array([r[k] for r in rows], dtype=np.int64), sizes) for k in range(3)]
        columns.append(np.concatenate([r[4] + np.arange(n) for r, n in zip(rows, sizes)] or [np.empty(0, dtype=np.int64)]))
        columns.append(np.array([t for r in rows for t in r[3]], dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)

    def work(batches):
        rows, held = [], 0
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                docs = {(w["leaf"], w["line"]): w["docs"] for w in wanted.as_py()}
                for line in _lines(text.as_py()):
                    at = place(line, depth, constant)
                    n = docs.pop(at, None)
                    if n:
                        behind = [_signed(xxhash.xxh64_intdigest(t)) for t in tokens_of(line, depth, constant)[0][depth:]]
                        rows.append((*at, n, behind, depth) if behind else (*at, n, [0], -1))
                        held += len(rows[-1][3])
                if held > BATCH_TOKENS:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)

    return texts.mapInArrow(work, "leaf long, line long, docs long, pos long, token long")


def _finish(texts: DataFrame, depth: int, constant: float) -> DataFrame:
    """(key, n_removed, kept) of the texts that lose the lines ``gone`` lists."""

    def work(batches):
        for batch in batches:
            out = []
            for key, text, gone in zip(*(batch.column(k) for k in range(3))):
                lines, drop = _lines(text.as_py()), {(g["leaf"], g["line"]) for g in gone.as_py()}
                kept = [x for x in lines if place(x, depth, constant) not in drop]
                out.append((key.as_py(), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string()])],
                names=["key", "n_removed", "kept"],
            )

    return texts.mapInArrow(work, "key long, n_removed long, kept string")


def templates(pairs: DataFrame, rows: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, depth: int = DEPTH) -> DataFrame:
    """(leaf, line, template) of the lines of all leaves that enough documents reach.

    Lines of one leaf have the same number of tokens and the same leading ones. At the
    other places a token stays in the template if ``min_docs`` documents have it there;
    any other is a field. So a line's template depends on counts of its leaf alone, and a
    crowded leaf is counted in parts like any other. Values that are few of a leaf but in
    ``min_docs`` documents would make that many templates, the more the larger the leaf;
    so a line has a second template, in which a token stays only if ``COMMON`` of the
    leaf's documents have it too.
    """
    reached = pairs.select("id", "key", "leaf").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("reach"))
    reached = written(reached.where(F.col("reach") >= min_docs), "lines-leaves")
    lines = pairs.join(small(reached.select("leaf"), 16), "leaf")
    lines = lines.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("key").alias("key"))
    wanted = lines.groupBy("key").agg(F.collect_list(F.struct("leaf", "line", "docs")).alias("wanted"))
    texts = _chosen(rows, written(wanted, "lines-wanted"), ["key"]).select("text", "wanted")
    tokens = written(_tokens(texts, depth, constant).distinct(), "lines-tokens")
    # Documents, not their lines: those with several lines of a leaf count once for a token.
    again = pairs.join(small(reached.select("leaf"), 16), "leaf").groupBy("id", "key", "leaf").agg(F.collect_set("line").alias("lines"))
    again = again.where(F.size("lines") > 1).select("id", "key", "leaf", F.explode("lines").alias("line"))
    again = again.join(tokens.where("pos >= 0").select("leaf", "line", "pos", "token"), ["leaf", "line"])
    again = again.groupBy("id", "key", "leaf", "pos", "token").agg((F.lit(1) - F.count(F.lit(1))).alias("docs")).where("docs < 0")
    counted = tokens.select("leaf", "pos", "token", "docs").unionByName(again.select("leaf", "pos", "token", "docs"))
    stays = counted.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    stays = stays.join(small(reached, 24), "leaf").select("leaf", "pos", "token", "n", (F.col("n") >= COMMON * F.col("reach")).alias("common"))
    known = tokens.join(stays, ["leaf", "pos", "token"], "left")
    half, made, behind = F.lit(0xFFFFFFFF), [], F.col("pos") >= 0
    field = F.lit(_signed(xxhash.xxh64_intdigest(FIELD)))
    for k, stay in enumerate((F.col("n").isNotNull(), F.coalesce("common", F.lit(False)))):
        h = F.when(stay, F.xxhash64("pos", "token")).otherwise(F.xxhash64("pos"))
        made += [
            F.sum(h.bitwiseAND(half)).alias(f"low{k}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"high{k}"),
            F.count_if(stay & (F.col("token") != field) & behind).alias(f"kept{k}"),
        ]
    made = known.groupBy("leaf", "line").agg(F.count_if(behind).alias("many"), *made)
    both = [F.struct(F.xxhash64("leaf", f"low{k}", f"high{k}").alias("template"), F.col(f"kept{k}").alias("kept")) for k in (0, 1)]
    made = made.select("leaf", "line", "many", F.explode(F.array_distinct(F.array(*both))).alias("t")).select("leaf", "line", "many", "t.*")
    enough = (F.col("kept") >= constant * F.col("many")) & ((F.col("kept") >= MIN_KEPT) | (F.col("kept") == F.col("many")))
    return made.where(enough).drop("many", "kept")


def remove_recurring_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, depth: int = DEPTH,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_lines, n_removed and kept_sha256 (kept lines joined by line feeds).

    A line goes where one of its templates occurs in ``min_docs`` documents. Tokens are runs
    without white space of ASCII; those that hold a digit are fields from the start, but
    a line with few others, and one of at most ``depth`` tokens, is taken as it is.
    Blank lines stay. A null text has no
    lines, an empty one has one. Rows that repeat id and text count as one document,
    null ids as an id. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.col(text_col).cast("binary").alias("text"),
    )
    base = written(_scan(rows, depth, constant), "lines-base")
    pairs = base.select("id", "key", F.explode("places").alias("p")).select("id", "key", "p.leaf", "p.line").distinct()
    pairs = written(pairs, "lines-pairs")
    made = written(templates(pairs, rows.select("key", "text"), min_docs, constant, depth), "lines-templates")
    placed = pairs.join(made, ["leaf", "line"])
    common = placed.select("template", "id", "key").distinct().groupBy("template").count().where(F.col("count") >= min_docs)
    common = made.join(common, "template").select("leaf", "line").distinct()
    gone = pairs.join(small(written(common, "lines-common"), 32), ["leaf", "line"]).select("key", "leaf", "line").distinct()
    gone = written(gone.groupBy("key").agg(F.collect_list(F.struct("leaf", "line")).alias("gone")), "lines-gone")
    lost = _finish(_chosen(rows.select("key", "text"), gone, ["key"]).select("key", "text", "gone"), depth, constant).dropDuplicates(["key"])
    out = base.select("id", "key", "n_lines", "sha").join(small(written(lost, "lines-lost"), 120), "key", "left")
    return out.select(
        "id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
