"""Byte-level BPE: propose tokens greedily, verify adjacent pairs, merge where they fail."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import share

#: Pieces of text, and words, whose tokens a task remembers; one takes about 200 bytes.
CACHE_PIECES = 250_000
#: The pattern of byte-level pre-tokenisation; fixed value, L, N and S stand for the classes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{s}{l}{n}]+|{S}+(?!{notS})|{S}+"
#: A line feed with text on both sides is a piece of its own, and a space there starts a new one.
LINES = re.compile(r"(?<!\s)\n(?!\s|\Z)")
CUT = re.compile(r"(?<!\s) (?!\s|\Z)")
#: Words of at most so many bytes are proposed and merged by whole arrays.
SHORT = 48


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ranges(codes) -> str:
    """Code points as the inside of a character class."""
    out, codes = [], sorted(codes)
    start = last = None
    for c in [*codes, None]:
        if start is not None and c != last + 1:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
        if start is None:
            start = c
        last = c
    return "".join(out)


def newer_letters(path: str) -> tuple[list[int], list[int]]:
    """Code points that the pattern engine calls letters or numbers and the file's library doesn't yet.

    Two libraries know different Unicode versions; only code points that are unassigned
    in one of them are asked for.
    """
    import unicodedata

    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    found: tuple[list[int], list[int]] = ([], [])
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch) != "Cn":
            continue
        for kind, sign, out in ((letter, "a", found[0]), (number, "1", found[1])):
            if kind.match(ch) and len(pre.pre_tokenize_str(sign + ch)) > 1:
                out.append(c)
    return found


class Lookup:
    """Values of 64-bit keys for whole arrays: open addressing in numpy."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            spot, first = np.unique(at[left], return_index=True)
            free = self.keys[spot] < 0
            put = left[first[free]]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 where it is unknown."""
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, ready for whole arrays of pairs.

    Merges are numbered by rank. Every token has the merge that makes it and, for each
    step down its left and right edge, the token found there and the rank at which that
    one is merged into the next; at a boundary of two tokens these decide whether a merge
    across it would come first.
    """

    FREE = np.int64(1) << 40

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int], newer: tuple[list[int], list[int]]):
        letters = byte_letters()
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.bytes |= {i: t.encode() for t, i in special.items()}
        self.special = special
        self.ids = {b: i for i, b in self.bytes.items() if i not in special.values()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.ranks.setdefault((a, b), rank)
            self.made.setdefault((a, b), c)
            parts.setdefault(c, (a, b, rank))
        n = max(self.bytes) + 1
        self.width = np.int64(n)
        keys = np.array([a * n + b for a, b in self.ranks], dtype=np.int64)
        self.pairs = Lookup(keys, np.array(list(self.ranks.values()), dtype=np.int64))
        self.made_by = np.full(len(merges), -1, dtype=np.int64)
        for pair, rank in self.ranks.items():
            self.made_by[rank] = self.made[pair]
        self._trie()
        self.rank_of = np.full(n, -1, dtype=np.int64)
        for token, (_, _, rank) in parts.items():
            self.rank_of[token] = rank
        self.edges = [self._edge(parts, n, side) for side in (0, 1)]
        newer_l, newer_n = (_ranges(x) for x in newer)
        l = rf"[\p{{L}}--[{newer_l}]]" if newer_l else r"\p{L}"
        m = rf"[\p{{N}}--[{newer_n}]]" if newer_n else r"\p{N}"
        self.plain_split = regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", S=r"\s", notS=r"\S", s=r"\s", l=r"\p{L}", n=r"\p{N}"))
        self.exact_split = regex.compile(SPLIT.format(L=l, N=m, S=r"\s", notS=r"\S", s=r"\s", l=l, n=m), regex.V1)
        odd = _ranges({*newer[0], *newer[1]})
        self.odd = regex.compile(f"[{odd}]") if odd else None

    @staticmethod
    def _edge(parts, n, side) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per step down an edge: the token there (-1: none) and the rank that absorbs it."""
        token, until = np.arange(n, dtype=np.int64), np.full(n, Vocabulary.FREE)
        steps = []
        below = np.full(n, -1, dtype=np.int64)
        rank = np.full(n, -1, dtype=np.int64)
        for t, p in parts.items():
            below[t], rank[t] = p[side], p[2]
        while (token >= 0).any():
            steps.append((token, until))
            until = np.where(token >= 0, rank[token], -1)
            token = np.where(token >= 0, below[token], -1)
        return steps

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays as it is when their bytes are encoded together.

        It does unless some merge joins a token of the left one's right edge with one of
        the right one's left edge while both are there. Of merges of the same rank the
        leftmost comes first.
        """
        fine = np.ones(len(left), dtype=bool)
        for a_token, a_until in self.edges[1]:
            a = a_token[left]
            if not (a >= 0).any():
                break
            for b_token, b_until in self.edges[0]:
                b = b_token[right]
                live = np.flatnonzero((a >= 0) & (b >= 0) & fine)
                if not len(live):
                    break
                rank = self.pairs.get(a[live] * self.width + b[live])
                # Both are there from the later of their own merges on.
                born = np.maximum(self.rank_of[a[live]], self.rank_of[b[live]])
                hit = (rank > born) & (rank < a_until[left[live]]) & (rank <= b_until[right[live]])
                fine[live[hit]] = False
        return fine

    def _trie(self) -> None:
        """Nodes of the trie of all tokens: steps by node and byte, and the token that ends there."""
        steps: dict[int, int] = {}
        ends = [-1]
        for token, i in self.ids.items():
            node = 0
            for byte in token:
                node = steps.setdefault(node * 256 + byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.steps = Lookup(np.array(list(steps), dtype=np.int64), np.array(list(steps.values()), dtype=np.int64))
        self.ends = np.array(ends, dtype=np.int64)
        self.first = self.steps.get(np.arange(256, dtype=np.int64))

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words at once: tokens, and the word of each."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        stop = np.cumsum(size)
        tokens, owner = [], []
        live = np.flatnonzero(size)
        at = (stop - size)[live]
        while len(live):
            # Walk all words down the trie from where they stand, keeping the last token passed.
            node = self.first[data[at]]
            token, after = self.ends[node], at + 1
            here, going = at + 1, np.arange(len(live))
            while len(going):
                going = going[here[going] < stop[live[going]]]
                nxt = self.steps.get(node[going] * 256 + data[here[going]])
                going, nxt = going[nxt >= 0], nxt[nxt >= 0]
                node[going] = nxt
                here[going] += 1
                end = self.ends[nxt]
                done = end >= 0
                token[going[done]], after[going[done]] = end[done], here[going[done]]
            tokens.append(token)
            owner.append(live)
            more = after < stop[live]
            live, at = live[more], after[more]
        if not tokens:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        flat, word = np.concatenate(tokens), np.concatenate(owner)
        order = np.argsort(word, kind="stable")
        return flat[order], word[order]

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Exact merging by rank of many words, those of one length together."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        base = np.array(self.byte_ids, dtype=np.int64)
        free = len(self.ranks)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            if n < 2 or n > SHORT:
                for r in rows:
                    out[r] = tuple(self.merge(words[r]))
                continue
            tokens = base[np.frombuffer(b"".join(words[r] for r in rows), dtype=np.uint8).reshape(-1, n)]
            ranks = self.pairs.get((tokens[:, :-1] * self.width + tokens[:, 1:]).ravel()).reshape(-1, n - 1)
            ranks[ranks < 0] = free
            while len(rows):
                best = ranks.argmin(1) if ranks.shape[1] else None
                lines = np.arange(len(rows))
                done = ranks[lines, best] == free if best is not None else np.ones(len(rows), dtype=bool)
                for r, t in zip(rows[done], tokens[done].tolist()):
                    out[r] = tuple(t)
                if done.all():
                    break
                rows, tokens, ranks, best = rows[~done], tokens[~done], ranks[~done], best[~done]
                lines, width = np.arange(len(rows)), tokens.shape[1]
                tokens[lines, best] = self.made_by[ranks[lines, best]]
                keep = np.arange(width - 1)
                tokens = np.take_along_axis(tokens, keep + (keep > best[:, None]), 1)
                keep = np.arange(width - 2)
                ranks = np.take_along_axis(ranks, keep + (keep >= best[:, None]), 1)
                for side in (best - 1, best):
                    ok = np.flatnonzero((side >= 0) & (side < width - 2))
                    if len(ok):
                        s = side[ok]
                        found = self.pairs.get(tokens[ok, s] * self.width + tokens[ok, s + 1])
                        ranks[ok, s] = np.where(found < 0, free, found)
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Exact merging by rank."""
        tokens = [self.byte_ids[x] for x in piece]
        if len(tokens) > 40:
            return self._merge_long(tokens)
        ranks, free = self.ranks, len(self.ranks)
        while len(tokens) > 1:
            pairs = list(zip(tokens, tokens[1:]))
            found = [ranks.get(p, free) for p in pairs]
            best = min(found)
            if best == free:
                break
            i = found.index(best)
            tokens[i : i + 2] = [self.made[pairs[i]]]
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same over a linked list with a heap of pairs, for pieces of any length."""
        import heapq

        n = len(tokens)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.ranks[p], i, p) for i in range(n - 1) if (p := (tokens[i], tokens[i + 1])) in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (tokens[i], tokens[j]) != pair:
                continue
            tokens[i], alive[j] = self.made[pair], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (tokens[a], tokens[b])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], a, p))
        return [t for t, x in zip(tokens, alive) if x]

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of each word: proposals that pass all checks, else exact merging."""
        flat, word = self.propose(words)
        good = np.ones(len(words), dtype=bool)
        # A token that its own bytes don't encode to fails its word.
        good[word[~self.own[flat]]] = False
        inside = np.flatnonzero(word[1:] == word[:-1])
        if len(inside):
            keys = flat[inside] * self.width + flat[inside + 1]
            pairs, back = np.unique(keys, return_inverse=True)
            fine = self.compatible(pairs // self.width, pairs % self.width)
            good[word[inside[~fine[back]]]] = False
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        tokens = flat.tolist()
        out = [tuple(tokens[a:b]) for a, b in zip(cuts, cuts[1:])]
        failed = np.flatnonzero(~good)
        for i, t in zip(failed.tolist(), self.merge_many([words[i] for i in failed])):
            out[i] = t
        return out

    @property
    def own(self) -> np.ndarray:
        """Whether merging a token's bytes gives the token."""
        if not hasattr(self, "_own"):
            self._own = np.zeros(int(self.width), dtype=bool)
            for b, i in self.ids.items():
                self._own[i] = self.merge(b) == [i]
        return self._own


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE file on the driver. Vocabulary files have a few MB."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    vocabulary = Vocabulary(data["model"]["vocab"], data["model"]["merges"], special, newer_letters(path))
    vocabulary.own  # noqa: B018  computed once, before it is sent
    return vocabulary


class Coder:
    """Encodes and decodes texts, remembering the tokens of words and pieces.

    Tokens are kept as text with a comma before each id. Pieces are encoded on their own,
    so what a text encodes to is what its pieces give in a row. Where the ids of every word
    decode to the word, which is compared when a word is learned, a text decodes to itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, str] = {}
        self.first: dict[str, str] = {}  # pieces without their space before
        self.later: dict[str, str] = {}
        self.shown = {i: f",{i}" for i in vocabulary.bytes}
        self.special = {t: self.shown[i] for t, i in vocabulary.special.items()}
        self.exact = all(vocabulary.bytes[i] == t.encode() for t, i in vocabulary.special.items())
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _learn(self, pieces: set, known: dict, lead: str) -> None:
        new = list(_missing(pieces, known))
        v, split = self.v, []
        for p in new:
            text = lead + p
            engine = v.exact_split if v.odd and not text.isascii() and v.odd.search(text) else v.plain_split
            split.append(engine.findall(text))
        fresh = list(_missing({w for s in split for w in s}, self.words))
        raw = [w.encode() for w in fresh]
        shown, letters = self.shown, v.bytes
        for w, data, ids in zip(fresh, raw, v.encode_words(raw)):
            self.words[w] = "".join([shown[i] for i in ids])
            self.exact = self.exact and b"".join([letters[i] for i in ids]) == data
        words = self.words
        for p, s in zip(new, split):
            known[p] = words[s[0]] if len(s) == 1 else "".join([words[w] for w in s])

    def encode_batch(self, texts: list[str]) -> Iterator[str]:
        """The ids of each text, a comma before each."""
        cut = []
        for t in texts:
            parts = self.specials.split(t) if self.specials else [t]
            cut.append([[CUT.split(x) for x in LINES.split(s)] if k % 2 == 0 else s for k, s in enumerate(parts)])
        lines = [x for parts in cut for s in parts[::2] for x in s]
        self._learn({x[0] for x in lines} | {"\n"}, self.first, "")
        self._learn({p for x in lines for p in x[1:]}, self.later, " ")
        feed, first, later = self.first["\n"], self.first, self.later
        for parts in cut:
            out: list[str] = []
            for s in parts:
                if isinstance(s, str):
                    out.append(self.special[s])
                    continue
                for k, x in enumerate(s):
                    if k:
                        out.append(feed)
                    out.append(first[x[0]])
                    out += [later[p] for p in x[1:]]
            yield "".join(out)

    def decode(self, ids: str, text: str) -> str:
        """Text that the ids of ``text`` decode to; bytes that aren't UTF-8 are replaced."""
        if self.exact:
            return text
        return b"".join([self.v.bytes[i] for i in ids_of(ids)]).decode("utf-8", errors="replace")


def _missing(asked: set, known: dict) -> set:
    """What ``known`` lacks. Where it would grow too large it keeps its older half first.

    What is frequent is met early, so the older half is asked for most.
    """
    new = asked.difference(known)
    if len(known) + len(new) > CACHE_PIECES:
        kept = list(islice(known.items(), CACHE_PIECES // 2))
        known.clear()
        known.update(kept)
        new = asked.difference(known)
    return new


def ids_of(ids: str) -> list[int]:
    """Token ids of an encoded text."""
    return [int(i) for i in ids[1:].split(",")] if ids else []


SCHEMA = "id long, ids array<int>, decoded string"
#: Texts that are cut and learned together.
BATCH_CHARS = 1_000_000


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of a bounded size, each with its offset; a longer text is a run of its own."""
    start, chars, run = 0, 0, []
    for k, x in enumerate(column):
        text = x.as_py() or ""
        if run and chars + len(text) > BATCH_CHARS:
            yield start, run
            start, chars, run = k, 0, []
        run.append(text)
        chars += len(text)
    if run:
        yield start, run


def _over(docs: DataFrame, path: str, id_col: str, text_col: str, fields: list[tuple[str, pa.DataType]], ddl: str, row):
    """Run ``row`` on the encoded pieces of every text."""
    spark = docs.sparkSession
    vocabulary = share(spark, load(path))
    schema = pa.schema([("id", pa.int64()), *fields])

    def work(batches):
        coder = Coder(vocabulary.value)
        names = [n for n, _ in fields]
        for batch in batches:
            for start, texts in _batches(batch.column(1)):
                rows = [row(coder, x, text) for x, text in zip(coder.encode_batch(texts), texts)]
                columns = [pa.array([r[k] for r in rows], type=t) for k, (_, t) in enumerate(fields)]
                ids = batch.column(0).slice(start, len(texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *columns], schema=pa.schema([schema.field(0), *[schema.field(n) for n in names]]))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, ddl)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and the ids of its whole text (null and empty texts: none)."""
    return _over(
        docs, path, id_col, text_col, [("ids", pa.list_(pa.int32()))], "id long, ids array<int>", lambda coder, x, text: (ids_of(x),)
    )


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the ids of its whole text and the text they decode to."""
    fields = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    return _over(docs, path, id_col, text_col, fields, SCHEMA, lambda coder, x, text: (ids_of(x), coder.decode(x, text)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 and decoded_sha256.

    As :func:`encode_and_decode`, without moving ids and texts back to the JVM. Null and
    empty texts have no ids; repeated rows and null ids stay; other columns aren't read.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def row(coder, ids, text):
        decoded = coder.decode(ids, text).encode()
        return ids.count(","), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _over(docs, path, id_col, text_col, fields, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
