"""Repair the structure of conversations at the least cost, and say which edits do it.

Turns are numbered over the whole table and cut into segments of one conversation and at
most ``BLOCK`` turns, so that a conversation of any length is solved in parts:

1. each segment's costs from any state of the grammar to any other;
2. per conversation these small matrices, folded from its end, give the cost that is left
   behind every segment;
3. each segment's dynamic programme, its optimal arcs, and their least path: nodes are
   ranked by the least audits of 1, 2, 4, ... edits that start there, each round from the
   ranks of the round before at the node and at the node its pointer leads to; an arc is
   chosen by its letter and the rank of its target, and the path is read off by doubled
   pointers;
4. per conversation the states in which its segments are entered, folded from its start;
5. one pass over each conversation's turns applies the edits and digests the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import written
from logwarden.operators.ordering import numbered

#: Turns of a segment at most.
BLOCK = 4096
#: Nodes that are ranked together.
BATCH_NODES = 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of the edits in the order of their codes; 0 ends an audit.
LETTERS = b"\0DIKR"
#: States of ``(s?(ua)+)?``: nothing yet, behind s, behind u, behind a (the first and the last may end).
START, S, U, A = range(4)
#: The state behind the role that may come next, and behind each initial (s, u, a, other; -1: not allowed).
NEXT = np.array([U, U, A, U])
STEP = np.array([[S, U, -1, -1], [-1, U, -1, -1], [-1, -1, A, -1], [-1, U, -1, -1]])
#: What it costs to end in each state: insertions to the next end.
END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
LEGAL = {(0, 1), (1, 2), (2, 1)}
INF = np.int64(1) << 40
FINE, CUT_OFF, DUPLICATE, BLANK = range(4)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``conversations`` (nulls of role and text: one space) with the faults of a test set.

    crc32 of ``conv_id:turn`` (null: one space) modulo 20 decides: 0 drops a row, 1 empties its
    text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        fault.alias("fault"),
    ).where("fault <> 0")
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_copy", copies).drop("_copy", "fault")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def marked(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, rows): both written, with ``idx`` (unique, growing by conversation and turn) and ``conv``.

    Facts have turn, ``code`` for the role's initial and ``kind`` for the first fault; rows have role and text.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("head", F.substring("text", 1, 100)).withColumn("digest", F.sha2("text", 256))
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    rows = numbered(rows, "conv", "turn", "role", "head", "digest", "salt", name="idx").drop("head", "salt")
    first = rows.groupBy("conv", "role", "digest").agg(F.min("idx").alias("idx")).select("idx", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    ended = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    facts = rows.select("idx", "conv", "turn", _initial(F.col("role")).alias("code"), blank.alias("blank"), ended.alias("ended"))
    facts = facts.join(first, "idx", "left")
    kind = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("ended"), CUT_OFF).otherwise(FINE)
    facts = written(facts.select("idx", "conv", "turn", "code", kind.alias("kind")), "repair-facts")
    return facts, rows.select("idx", "conv", "role", "text")


def relaxed(cost: np.ndarray) -> np.ndarray:
    """Costs [..., state] when rows may be inserted here as well."""
    u = np.minimum(cost[..., U], cost[..., A] + INSERT)
    a = np.minimum(cost[..., A], cost[..., U] + INSERT)
    return np.stack([np.minimum(cost[..., START], u + INSERT), np.minimum(cost[..., S], u + INSERT), u, a], axis=-1)


def costs(codes: np.ndarray, kinds: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[row, segment, state]: the least cost from before each row to behind the segment, which costs ``end``."""
    g, n = codes.shape
    out = np.empty((n + 1, g, 4), dtype=np.int64)
    out[n] = end
    every = np.arange(g)[:, None]
    for p in range(n - 1, -1, -1):
        keep, reroled = _arcs(codes[:, p], kinds[:, p], out[p + 1], every)
        out[p] = np.minimum(relaxed(np.minimum(np.minimum(out[p + 1] + DELETE, keep), reroled)), INF)
    return out


def _arcs(code: np.ndarray, kind: np.ndarray, after: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[segment, state]: costs over keeping a row and over giving it the role that may come next."""
    extra = np.where(kind == CUT_OFF, TRUNCATED, 0)[:, None]
    stays = (kind < DUPLICATE)[:, None]
    to = STEP[:, code].T
    keep = np.where(stays & (to >= 0), after[every, np.maximum(to, 0)] + KEEP + extra, INF)
    return keep, np.where(stays, after[:, NEXT] + REROLE + extra, INF)


def audits(codes: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, end: np.ndarray, last: np.ndarray) -> tuple[list, np.ndarray]:
    """(audits, exits): per segment and state of entry the least audit of all cheapest, and the state behind it.

    Rows of a segment stand at the right of ``codes``. Rows may be inserted before each row,
    and behind the last one only where the conversation ends.
    """
    g, n = codes.shape
    cost = costs(codes, kinds, end)
    every = np.arange(g)[:, None]
    node = np.arange(cost.size).reshape(cost.shape)
    target = np.zeros((5, *cost.shape), dtype=np.int64)
    valid = np.zeros((5, *cost.shape), dtype=bool)
    target[1, :-1], target[2], target[4, :-1] = node[1:], node[:, :, NEXT], node[1:][:, :, NEXT]
    valid[1, :-1] = cost[1:] + DELETE == cost[:-1]
    valid[2] = cost[:, :, NEXT] + INSERT == cost
    valid[2, n] &= last[:, None]
    valid[0, n] = np.where(last[:, None], END == 0, True)
    target[0] = node
    for p in range(n):
        keep, reroled = _arcs(codes[:, p], kinds[:, p], cost[p + 1], every)
        valid[3, p], valid[4, p] = (keep == cost[p]) & (keep < INF), (reroled == cost[p]) & (reroled < INF)
        target[3, p] = node[p + 1][every, np.maximum(STEP[:, codes[:, p]].T, 0)]
    valid, target = valid.reshape(5, -1), target.reshape(5, -1)
    nodes = np.arange(valid.shape[1])
    # No two arcs of a node share a letter, so the least letters from a node name the node they lead to.
    rank = np.argmax(valid, axis=0)
    ends, jump = rank == 0, target[rank, nodes]
    while not ends[jump].all():
        pair = rank * (rank.max() + 1) + rank[jump]
        rank, jump = np.unique(pair, return_inverse=True)[1].reshape(-1), jump[jump]
    pair = rank * (rank.max() + 1) + rank[jump]
    rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
    wide = np.int64(rank.max() + 1)
    letter = np.argmin(np.where(valid, np.arange(5)[:, None] * wide + rank[target], INF), axis=0)
    jump = target[letter, nodes]
    path = node[n - sizes, np.arange(g)].reshape(-1, 1)
    while not ends[path[:, -1]].all():
        path = np.concatenate([path, jump[path]], axis=1)
        jump = jump[jump]
    shown = np.frombuffer(LETTERS, dtype=np.uint8)[letter[path]]
    found = [row.tobytes().rstrip(b"\0").decode() for row in shown]
    return [found[4 * k : 4 * k + 4] for k in range(g)], (path[:, -1] % 4).reshape(g, 4)


def _groups(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(segments, sizes, codes, kinds) for runs of segments of about the same size, rows at the right."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    width = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for w in np.unique(width).tolist():
        found = np.flatnonzero(width == w)
        step = max(1, BATCH_NODES // (4 * (w + 1)))
        for at in range(0, len(found), step):
            chosen = found[at : at + step]
            n = size[chosen]
            row = np.repeat(np.arange(len(chosen)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cells = np.full((len(chosen), w), 3, dtype=np.int64)
            cells[row, np.repeat(w - n, n) + place] = values[np.repeat(offsets[chosen], n) + place]
            yield chosen, n, cells % 4, cells // 4


def _matrices(segments: DataFrame) -> DataFrame:
    """Per segment: first and last initial, illegal pairs inside, and the 16 costs from state to state."""

    def work(batches):
        for batch in batches:
            turns = batch.column(2)
            out = np.zeros((batch.num_rows, 16), dtype=np.int64)
            facts = np.zeros((batch.num_rows, 3), dtype=np.int64)
            for chosen, n, codes, kinds in _groups(turns):
                w = codes.shape[1]
                at = np.arange(len(chosen))
                for to in range(4):
                    end = np.where(np.arange(4) == to, 0, INF)
                    out[chosen, to::4] = costs(codes, kinds, np.tile(end, (len(chosen), 1)))[w - n, at]
                pairs = codes[:, :-1] * 4 + codes[:, 1:]
                inner = np.arange(w - 1)[None, :] >= (w - n)[:, None]
                wrong = inner & ~np.isin(pairs, [a * 4 + b for a, b in LEGAL])
                facts[chosen] = np.stack([codes[at, w - n], codes[:, -1], wrong.sum(1)], axis=1)
            cells = pa.ListArray.from_arrays(np.arange(0, out.size + 1, 16, dtype=np.int32), pa.array(out.ravel()))
            columns = [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(f)) for f in facts.T), cells]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "conv", "first", "last", "wrong", "m"])

    kind = segments.schema["conv"].dataType.simpleString()
    return segments.select("sid", "conv", "turns").mapInArrow(
        work, f"sid long, conv {kind}, first long, last long, wrong long, m array<long>"
    )


def _ends(chains: DataFrame) -> DataFrame:
    """Per conversation its cost and illegal pairs, and per segment the costs behind it and its place."""

    def work(batches):
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                end, behind = END, []
                for k in range(len(parts) - 1, -1, -1):
                    behind.append((parts[k]["sid"], end.tolist(), k == 0, k == len(parts) - 1))
                    end = (np.array(parts[k]["m"]).reshape(4, 4) + end).min(1)
                met = sum((a["last"], b["first"]) not in LEGAL for a, b in zip(parts, parts[1:]))
                shown = [dict(zip(("sid", "behind", "head", "tail"), x)) for x in behind]
                out.append((int(end[START]), met + sum(p["wrong"] for p in parts), shown))
            each = pa.struct([("sid", pa.int64()), ("behind", pa.list_(pa.int64())), ("head", pa.bool_()), ("tail", pa.bool_())])
            columns = [pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(each)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv", "cost", "illegal", "parts"])

    kind = chains.schema["conv"].dataType.simpleString()
    return chains.mapInArrow(
        work,
        f"conv {kind}, cost long, illegal long, parts array<struct<sid:long,behind:array<long>,head:boolean,tail:boolean>>",
    )


def _solved(segments: DataFrame) -> DataFrame:
    """Per segment the least audits and states behind it, by state of entry (a conversation's first: START only)."""

    def work(batches):
        for batch in batches:
            end = batch.column(3).flatten().to_numpy().reshape(-1, 4) if batch.num_rows else np.empty((0, 4))
            head = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            last = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            texts, exits = [None] * batch.num_rows, [None] * batch.num_rows
            for chosen, n, codes, kinds in _groups(batch.column(2)):
                found, out = audits(codes, kinds, n, end[chosen], last[chosen])
                for k, i in enumerate(chosen.tolist()):
                    many = 1 if head[i] else 4
                    texts[i], exits[i] = found[k][:many], out[k, :many].tolist()
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "conv", "audits", "exits"])

    kind = segments.schema["conv"].dataType.simpleString()
    columns = segments.select("sid", "conv", "turns", "behind", "head", "tail")
    return columns.mapInArrow(work, f"sid long, conv {kind}, audits array<string>, exits array<long>")


def _entered(chains: DataFrame) -> DataFrame:
    """Per conversation its audit, and per segment the state of entry and its part of the audit."""

    def work(batches):
        for batch in batches:
            whole, shown = [], []
            for parts in batch.column(1).to_pylist():
                state, chosen = START, []
                for p in parts:
                    chosen.append({"sid": p["sid"], "state": state, "edits": p["audits"][state]})
                    state = p["exits"][state]
                whole.append("".join([c["edits"] for c in chosen]))
                shown.append(chosen)
            each = pa.struct([("sid", pa.int64()), ("state", pa.int64()), ("edits", pa.string())])
            columns = [batch.column(0), pa.array(whole, pa.string()), pa.array(shown, pa.list_(each))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "audit", "parts"])

    kind = chains.schema["conv"].dataType.simpleString()
    return chains.mapInArrow(work, f"conv {kind}, audit string, parts array<struct<sid:long,state:long,edits:string>>")


class _Tape:
    """Applies the edits of one segment after another to the turns that follow them."""

    def __init__(self, edits: str | None, state: int):
        self.edits, self.at, self.state = edits or "", 0, state

    def _next_role(self) -> str:
        role = "assistant" if self.state == U else "user"
        self.state = int(NEXT[self.state])
        return role

    def inserted(self) -> list[tuple[str, str]]:
        """Rows that stand before the next turn."""
        out = []
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            out.append((self._next_role(), ""))
        return out

    def turn(self, role: str, text: str) -> list[tuple[str, str]]:
        out = self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            out.append((self._next_role(), text))
        elif edit == "K":
            self.state = int(STEP[self.state, "sua".index(role[0])])
            out.append((role, text))
        return out


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, place, role, text): the turns of every repaired conversation, in order by ``place``.

    ``rows`` have conv, idx, role and text, ``edits`` conv, sid, state and edits. A conversation
    is read once, in order, by one task; nothing of it is held but the edits of one segment.
    """
    kind = rows.schema["conv"].dataType.simpleString()

    def work(batches):
        tape, conv, place = _Tape(None, START), None, 0
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for of, edits_, state, role, text in zip(*columns):
                made = tape.turn(role, text) if edits_ is None else tape.inserted()
                out += [(conv, place + k, *x) for k, x in enumerate(made)]
                place += len(made)
                if edits_ is not None:
                    place = 0 if state == START else place
                    tape, conv = _Tape(edits_, state), of
            yield _table(out)
        yield _table([(conv, place + k, *x) for k, x in enumerate(tape.inserted())])

    names = ["conv", "place", "role", "text"]
    shape = pa.schema([("conv", _arrow(rows)), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def _table(out):
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, shape)], names=names)

    none = F.lit(None)
    left = edits.select("conv", F.col("sid").alias("idx"), F.lit(0).alias("turn"), "edits", "state", none.cast("string").alias("role"), none.cast("string").alias("text"))
    right = rows.select("conv", "idx", F.lit(1).alias("turn"), none.cast("string").alias("edits"), none.cast("long").alias("state"), "role", "text")
    tape = left.unionByName(right).repartition("conv").sortWithinPartitions("conv", "idx", "turn")
    return tape.select("conv", "edits", "state", "role", "text").mapInArrow(work, f"conv {kind}, place long, role string, text string")


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv"].dataType)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of turns that come in order, conversation by conversation."""
    kind, arrow = turns.schema["conv"].dataType.simpleString(), _arrow(turns)

    def work(batches):
        conv, sha = None, None
        for batch in batches:
            done = []
            for of, place, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if sha is None or of != conv or place == 0:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = of, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield _pairs(done)
        yield _pairs([(conv, sha.hexdigest())] if sha is not None else [])

    def _pairs(done):
        columns = list(zip(*done)) or [[]] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (arrow, pa.string()))], names=["conv", "repaired_sha256"])

    return turns.select("conv", "place", "role", "text").mapInArrow(work, f"conv {kind}, repaired_sha256 string")


def repair(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` has conv_id, turn, role and text. Turns are taken in order (null first); those
    that share a number follow their role, then the first 100 characters of their text,
    then its digest. A row's first fault counts. Null roles and texts count as one space;
    null ids are one conversation. ``conversations`` names the conv_ids to report (all of
    ``turns`` by default); one without turns has zeros, an empty audit and the digest of
    nothing. Repeated rows are duplicates. Other columns are not read; an empty table gives
    an empty result. Texts are never held together: a conversation's digest is computed by
    one task, which streams its turns; every other step splits long conversations.
    """
    ids = (turns if conversations is None else conversations).select(F.col("conv_id").alias("conv")).distinct()
    facts, rows = marked(turns)
    count = {k: F.count_if(F.col("kind") == v).alias(k) for k, v in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT_OFF))}
    seen = facts.groupBy("conv").agg(*count.values(), F.max("turn").alias("high"), F.min("turn").alias("low"))
    numbers = facts.select("conv", "turn").distinct().groupBy("conv").agg(F.count("turn").alias("numbers"))
    block_of = F.floor(F.col("idx") / block)
    segments = facts.groupBy("conv", block_of.alias("block")).agg(
        F.min("idx").alias("sid"), F.sort_array(F.collect_list(F.struct("idx", (F.col("code") + 4 * F.col("kind")).alias("c")))).alias("turns")
    )
    segments = written(segments.select("sid", "conv", F.transform("turns", lambda x: x["c"]).alias("turns")), "repair-segments")

    def chains(parts: DataFrame) -> DataFrame:
        """The segments of each conversation in order: one small entry per ``block`` turns."""
        rest = [c for c in parts.columns if c not in ("sid", "conv")]
        return parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("sid", *rest))).alias("parts"))

    ends = written(_ends(chains(_matrices(segments))), "repair-ends")
    behind = ends.select(F.explode("parts").alias("p")).select("p.*")
    solved = _solved(segments.join(behind, "sid"))
    whole = written(_entered(chains(solved)), "repair-edits")
    edits = whole.select("conv", F.explode("parts").alias("p")).select("conv", "p.*")
    digest = digests(repaired_turns(rows, edits))
    out = ids
    for k, side in enumerate((seen, numbers, ends.select("conv", "cost", "illegal"), whole.select("conv", "audit"), digest)):
        side = side.withColumnRenamed("conv", f"c{k}")
        out = out.join(side, out["conv"].eqNullSafe(side[f"c{k}"]), "left").drop(f"c{k}")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("numbers"), F.lit(0)).cast("long").alias("gaps")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("conv").alias("conv_id"), gaps, *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
