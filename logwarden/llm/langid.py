"""Language identification: scripts narrow, then Viterbi over words labels spans."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import share, written

#: Scripts by the first code point of their ranges; fixed values of the Unicode blocks.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Other"),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"),
    (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Han"),
    (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAB30, "Latin"),
    (0xAB70, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x1B000, "Kana"), (0x1D000, "Other"), (0x20000, "Han"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])

#: Hash buckets of the byte trigrams of words.
BUCKETS = 1 << 16
#: A language is a candidate for a script that writes at least this share of its words.
SCRIPT_SHARE = 0.01
#: What changing the language between two words costs, and the most that one word can say.
SWITCH, WORD_LIMIT = 8.0, 6.0
#: Words of the documents that one Viterbi pass holds.
PASS_WORDS = 200_000
#: Characters of the texts whose words are scored together.
BATCH_CHARS = 4_000_000
#: Languages that a model learns at most; the table it sends has this many rows of ``BUCKETS``.
MAX_LANGS = 256

RUN = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    found = RUN.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else LETTERS.findall(run))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words, each word between two marks, and where each word's begin."""
    marked = [b"\x02" + w.encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)) - 2
    code = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
    inside = np.ones(len(code), dtype=bool)
    ends = np.cumsum(size + 2)[:-1]
    inside[ends - 1] = inside[ends - 2] = False
    buckets = (code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return buckets.astype(np.int64), np.cumsum(size) - size


def scripts(words: list[str]) -> np.ndarray:
    """The script of each word, by its first letter."""
    first = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
    return SCRIPT_OF[np.searchsorted(STARTS, first, side="right") - 1]


def counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, cell, n) over all rows: trigram buckets, then scripts, of all words."""

    def work(batches):
        totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + len(NAMES), dtype=np.int64))
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[lang].update(words_of(text.as_py()))
            for lang, known in seen.items():
                if known:
                    words, n = list(known), np.fromiter(known.values(), dtype=np.int64, count=len(known))
                    buckets, starts = grams(words)
                    each = np.diff(np.append(starts, len(buckets)))
                    totals[lang][:BUCKETS] += np.bincount(buckets, np.repeat(n, each), BUCKETS).astype(np.int64)
                    totals[lang][BUCKETS:] += np.bincount(scripts(words), n, len(NAMES)).astype(np.int64)
        for lang, total in totals.items():
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cells), type=pa.string()), pa.array(cells), pa.array(total[cells])],
                names=["lang", "cell", "n"],
            )

    rows = docs.select(F.col(lang_col), F.col(text_col)).mapInArrow(work, "lang string, cell long, n long")
    return rows.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Per language: a score for each trigram bucket, and the scripts it is written in."""

    def __init__(self, langs: list[str], sums: np.ndarray):
        self.langs = langs
        tri, script = sums[:, :BUCKETS], sums[:, BUCKETS:]
        chance = (tri + 0.5) / (tri.sum(1, keepdims=True) + 0.5 * BUCKETS)
        score = np.log(chance)
        mean = score.mean(0) if langs else 0.0
        self.score = (score - mean).T.astype(np.float32).copy()
        self.allowed = (script >= SCRIPT_SHARE * np.maximum(script.sum(1, keepdims=True), 1)).T & (script.T > 0)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of each word per language; NaN in all where no learned language uses its script."""
        buckets, starts = grams(words)
        size = np.diff(np.append(starts, len(buckets)))
        total = np.add.reduceat(self.score[buckets], starts, axis=0) / np.sqrt(size)[:, None]
        total = np.clip(total, -WORD_LIMIT, WORD_LIMIT)
        allowed = self.allowed[scripts(words)]
        total[~allowed] = -3 * WORD_LIMIT
        total[~allowed.any(1)] = np.nan
        return total


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Learn from all rows whose language is not null. The model has at most ``MAX_LANGS`` languages.

    With more of them the most frequent in words are learned.
    """
    sums = written(counts(docs.where(F.col(lang_col).isNotNull()), lang_col, text_col), "language-counts")
    sizes = sums.where(F.col("cell") >= BUCKETS).groupBy("lang").agg(F.sum("n").alias("words"))
    kept = [r[0] for r in sizes.orderBy(F.desc("words"), "lang").limit(MAX_LANGS).collect()]
    langs = sorted(kept)
    table = sums.where(F.col("lang").isin(langs)).toArrow() if langs else None
    out = np.zeros((len(langs), BUCKETS + len(NAMES)))
    if table is not None:
        place = {x: k for k, x in enumerate(langs)}
        rows = np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64)
        out[rows, table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, out)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels (documents x words) of the best paths; ``scores`` is words x documents x languages.

    Changing the language between two words costs ``switch``; ties keep the language,
    then take the first. What stands behind a document's end is -1.
    """
    steps, docs, langs = scores.shape
    best = scores[0].astype(np.float64)
    came = np.empty((steps, docs), dtype=np.int16)
    moved = np.zeros((steps, docs, langs), dtype=bool)
    rows = np.arange(docs)
    last = np.zeros(docs, dtype=np.int64)
    last[lengths == 1] = best[lengths == 1].argmax(1)
    for t in range(1, steps):
        top = best.argmax(1)
        jump = best[rows, top] - switch
        came[t] = top
        moved[t] = jump[:, None] > best
        best = np.maximum(best, jump[:, None]) + scores[t]
        ended = lengths == t + 1
        if ended.any():
            last[ended] = best[ended].argmax(1)
    labels = np.full((docs, steps), -1, dtype=np.int16)
    state = last
    for t in range(steps - 1, -1, -1):
        live = t < lengths
        labels[live, t] = state[live]
        if t:
            go = live & moved[t, rows, state]
            state = np.where(go, came[t], state)
    return labels


def label(model: Model, texts: list[str | None], switch: float = SWITCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the language of each word and whether the word says anything, in order."""
    found = [words_of(t) for t in texts]
    known: dict[str, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in ws), dtype=np.int64, count=len(ws)) for ws in found]
    if not known or not model.langs:
        yield from ((np.zeros(len(i), dtype=np.int16), np.zeros(len(i), dtype=bool)) for i in ids)
        return
    scores = model.word_scores(list(known))
    says = ~np.isnan(scores[:, 0])
    scores = np.nan_to_num(scores)
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    order = np.argsort(size, kind="stable")
    out: list = [None] * len(ids)
    at = 0
    while at < len(order):
        # Documents of like length run together, until their words fill a pass.
        stop = at + 1
        while stop < len(order) and size[order[stop]] * (stop + 1 - at) <= PASS_WORDS:
            stop += 1
        run = order[at:stop]
        longest = int(size[run].max())
        if longest:
            padded = np.full((len(run), longest), -1, dtype=np.int64)
            for k, d in enumerate(run):
                padded[k, : size[d]] = ids[d]
            grid = scores[padded.T]
            grid[padded.T < 0] = 0
            labels = viterbi(grid, size[run], switch)
        for k, d in enumerate(run):
            out[d] = (labels[k, : size[d]] if size[d] else np.empty(0, dtype=np.int16), says[ids[d]])
        at = stop
    yield from out


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    start, chars, run = 0, 0, []
    for k, x in enumerate(column):
        text = x.as_py()
        if run and chars + len(text or "") > BATCH_CHARS:
            yield start, run
            start, chars, run = k, 0, []
        run.append(text)
        chars += len(text or "")
    if run:
        yield start, run


def _over(docs: DataFrame, model: Model, id_col: str, text_col: str, ddl: str, types: list[pa.DataType], row) -> DataFrame:
    shared = share(docs.sparkSession, model)
    names = ["id", *[f"c{k}" for k in range(len(types))]]

    def work(batches):
        for batch in batches:
            for start, texts in _runs(batch.column(1)):
                rows = [row(shared.value, *found) for found in label(shared.value, texts)]
                columns = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *columns], names=names)

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        work, "id long, " + ", ".join(f"c{k} {d}" for k, d in enumerate(ddl.split("; ")))
    )
    return out


def _main(model: Model, labels: np.ndarray, says: np.ndarray) -> tuple[str, float]:
    if not len(labels) or not model.langs:
        return "und", 0.0
    share = np.bincount(labels[says], minlength=len(model.langs)) / len(labels)
    best = int(share.argmax())
    return model.langs[best], float(share[best])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred and score.

    The prediction is the language that labels most words; the score is the share of all
    words that it labels and whose script a learned language uses. Null texts and texts
    without a letter, and all texts if nothing was learned, are ``und`` with score 0.
    """
    out = _over(docs, model, id_col, text_col, "string; double", [pa.string(), pa.float64()], _main)
    return out.toDF("id", "lang_pred", "score")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and its spans (first word, words, lang) in order."""

    def row(model, labels, says):
        if not len(labels) or not model.langs:
            return ([],)
        starts = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
        size = np.diff(np.append(starts, len(labels)))
        return ([{"start": int(s), "words": int(n), "lang": model.langs[labels[s]]} for s, n in zip(starts, size)],)

    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
    out = _over(docs, model, id_col, text_col, "array<struct<start:long,words:long,lang:string>>", [kind], row)
    return out.toDF("id", "spans")


def labelled(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has a language with at least ``min_score``.

    Rejected are texts without a letter, and texts of which no learned language labels
    that share of the words: mixtures without a main language and unknown scripts.
    """
    shared = share(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            for start, texts in _runs(batch.column(at)):
                found = [_main(shared.value, *x) for x in label(shared.value, texts)]
                keep = pa.array([lang != "und" and score >= min_score for lang, score in found], type=pa.bool_())
                yield batch.slice(start, len(texts)).filter(keep)

    return docs.mapInArrow(work, docs.schema)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null ids have none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
