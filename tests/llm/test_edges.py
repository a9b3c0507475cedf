"""Edge cases that every operator and stage handles: nulls, empty and long texts, ties, repeats, clashing names."""

import gc
import weakref

import pytest
from pyspark.core.context import SparkContext
from pyspark.sql import functions as F

import corpus_pipeline
from logwarden.llm import bpe, chat, exact_dedup, langid, line_dedup, mixing, simhash_dedup, simhash_views, substring_dedup, topk, toxicity
from logwarden.llm.common import share
from logwarden.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "key", "h", "size", "n", "word", "keep_id", "copies", "node", "target"]
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat", "en", "a", 22),
    (2, "The Cat sat on the mat", "en", "a", 22),
    (2, "The Cat sat on the mat", "en", "a", 22),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "   \n\t ", "de", "b", 6),
    (6, "12 34 !?", "de", None, 8),
    (7, LONG, "en", "c", None),
    (None, "der hund lief über die straße", "de", "c", 30),
    (None, None, None, "c", None),
    (8, "der hund lief über die straße", "de", "c", 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "exact": exact_dedup.mark_duplicates,
    "mixing": mixing.mix,
    "bpe": lambda d: bpe.encode_and_decode(d, vocabulary_path()),
    "simhash": simhash_dedup.near_duplicates,
    "views": simhash_views.mark_groups,
    "lines": line_dedup.remove_recurring_lines,
    "substring": substring_dedup.remove_repeats,
    "language": lambda d: langid.predict(d, langid.fit(d)),
    "spans": lambda d: langid.spans(d, langid.fit(d)),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row(docs, name):
    out = OPERATORS[name](docs).select("id").collect()
    assert sorted(str(r[0]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, docs, empty, name, stage):
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in ROWS}
    assert stage(spark, empty, "").count() == 0


def test_last_stage(spark, docs, empty):
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(out) == len(ROWS)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0


def test_stages_let_go_of_what_earlier_ones_sent(spark, docs, tmp_path, monkeypatch):
    """Stages called one by one, as a driver of many runs does: no model or vocabulary of an earlier one is held."""
    sent, broadcast = [], SparkContext.broadcast

    def noted(self, value):
        out = broadcast(self, value)
        sent.append(weakref.ref(out))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", noted)
    for run in range(2):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{run}-{name}")
            stage(spark, rows, "").write.parquet(path)
            rows = spark.read.parquet(path)
    gc.collect()
    assert len(sent) == 4 and [x() is None for x in sent[:3]] == [True] * 3


def test_shared_values_are_held_in_bounded_number(spark):
    held = [weakref.ref(share(spark, [k])) for k in range(40)]
    gc.collect()
    assert sum(x() is not None for x in held) <= 4
    assert held[-1]().value == [39]


def test_mixing_joins_a_step_once(spark, docs, monkeypatch):
    """Each joined table is built in the driver's memory and stays there until it collects its garbage."""
    plans, write = [], mixing.written

    def noted(df, label):
        if label in ("mix-state", "mix-moves"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(mixing, "written", noted)
    mixing.mix(docs)
    assert len(plans) > 8 and max(p.count("Join ") for p in plans) <= 1


def test_exact_groups(docs):
    got = {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.mark_duplicates(docs).collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (3, 3, 3, True), (4, 3, 3, False), (None, 3, 3, False)} <= got
    assert {(8, 8, 2, True), (None, 8, 2, False)} <= got
    largest = {(r["id"], r["keep_id"], r["kept"]) for r in exact_dedup.mark_duplicates(docs, keep="largest").collect()}
    assert {(1, 2, False), (2, 2, True)} <= largest


def test_repeated_rows_leave_one(docs):
    kept = [r["doc_id"] for r in exact_dedup.drop_duplicates(docs, keep="largest").collect()]
    assert kept.count(2) == 1 and kept.count(1) == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_colliding_hashes_are_told_apart(docs, keep):
    """A hash that knows the length only makes different texts collide."""
    plain = exact_dedup.mark_duplicates(docs, keep=keep).drop("h")
    weak = exact_dedup.mark_duplicates(docs, keep=keep, hasher=lambda t: F.length(t) % 3).drop("h")
    assert sorted(map(str, plain.collect())) == sorted(map(str, weak.collect()))


def test_language_of_texts_without_letters(docs):
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5, 6))
    assert got[1][0] == "en" and got[8][0] == "de"


def test_near_copies_of_no_words_share_fingerprint_zero(docs):
    got = {r["id"]: (r["fp"], r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect() if r["id"]}
    assert got[3] == got[4] == got[5] == (0, 3)
    assert got[1][1] == got[2][1] == 1


def test_line_cases(docs):
    got = {r["id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.remove_recurring_lines(docs).collect() if r["id"]}
    assert got[3] == (0, 0) and got[4] == (1, 0) and got[5] == (2, 0)


def test_vectors(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [0.5, float("nan")]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None),
            (4, [1.0, None]), (5, [float("inf"), 0.0]), (6, [2.0]), (7, []), (100, []), (None, [1.0, 1.0]), (8, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    v = df.select("vec_id", topk.integer_vector(F.col("embedding")).alias("vector"))
    got = {tuple(r) for r in topk.search(v, v.where("vec_id % 50 = 0"), k=2).collect()}
    one = 256 * 256 + 128 * 256
    assert got == {(0, 1, 1, one), (0, 2, 2, one), (100, 1, 7, 0)}
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_search_in_several_blocks(spark):
    rows = [(i, [float((i * 37 + j * 11) % 23) / 7 for j in range(12)]) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>").select("vec_id", topk.integer_vector(F.col("v")).alias("vector"))
    q = v.where("vec_id % 20 = 0")
    one = sorted(map(tuple, topk.search(v, q).collect()))
    many = sorted(map(tuple, topk.search(v, q, block_bytes=500).collect()))
    ints = {i: [int(256 * x // 1) for x in xs] for i, xs in rows}
    want = []
    for i in range(0, 400, 20):
        scores = sorted((-sum(a * b for a, b in zip(ints[i], ints[j])), j) for j in ints if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert one == many == sorted(want)


def test_chats(spark):
    said = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    rows = [(1, t, *said[t]) for t in range(2)] + [(2, t, *said[t]) for t in range(4)] + [(3, t, *said[t]) for t in range(4)]
    rows += [(4, 0, "user", "a"), (4, 1, "assistant", "x"), (4, 1, "assistant", "x"), (5, 0, None, None), (None, None, "user", "q")]
    rows += [(6, t, *said[t % 4]) for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("n", F.lit(0)).withColumn("part", F.lit(9))
    out = chat.format_chats(df).collect()
    # 1 and 2 = 3 are snapshots of 6; a conversation of 600 turns is rendered in three parts.
    assert sorted((r["conv_id"] or -1, r["part"]) for r in out) == [(-1, 0), (4, 0), (5, 0), (6, 0), (6, 1), (6, 2)]
    whole = "".join(r["text"] for r in sorted(out, key=lambda r: r["part"]) if r["conv_id"] == 6)
    assert whole == "".join(f"<|im_start|>{said[t % 4][0]}\n{said[t % 4][1]}<|im_end|>\n" for t in range(600))
    alone = chat.format_chats(df.where("conv_id < 4")).collect()
    assert [(r["conv_id"], r["turns"], r["copies"]) for r in alone] == [(2, 4, 2)]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_parts_are_bounded(spark):
    """Rows without an id and a turn number, and many with one number, are dealt to parts as well."""
    rows = [(None, None, "user", f"text {k % 900}") for k in range(1500)] + [(1, 7, "user", f"t{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.repartition(5)).collect()
    shown = {}
    for r in sorted(out, key=lambda r: r["part"]):
        assert r["text"].count("<|im_start|>") <= chat.PART_TURNS
        shown[r["conv_id"]] = shown.get(r["conv_id"], "") + r["text"]
    assert {(r["conv_id"], r["turns"]) for r in out} == {(None, 900), (1, 600)}
    assert sorted(shown[1].split("<|im_end|>\n")[:-1]) == sorted(f"<|im_start|>user\nt{k}" for k in range(600))
    assert shown[None].count("<|im_start|>") == 900
