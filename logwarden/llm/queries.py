"""The queries of this package: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logwarden.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its SQL."""

    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def vocabulary_path() -> str:
    """The vocabulary file that the BPE query uses; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op7_bpe")
def op7_bpe(spark, sf_dir):
    from logwarden.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path()).withColumnRenamed("id", "doc_id")


@query(
    "op8_exact_dedup",
    """
    WITH rows AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
                  FROM documents),
    classes AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
    FROM rows JOIN classes USING (norm)
    """,
)
def op8_exact_dedup(spark, sf_dir):
    from logwarden.llm import exact_dedup

    marks = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return marks.withColumnRenamed("id", "doc_id").drop("h")


@query("op9_mixing")
def op9_mixing(spark, sf_dir):
    from logwarden.llm import mixing

    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.withColumnRenamed("id", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    from pyspark.sql import functions as F

    from logwarden.llm import simhash_dedup

    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), shown.alias("fingerprint"), "component_id")


@query(
    "op10_chat",
    """
    WITH turns AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations),
    whole AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS said FROM turns GROUP BY conv_id),
    cuts AS (SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, len(said))) AS k FROM whole)),
    kept AS (SELECT said, min(conv_id) AS conv_id, count(*) AS copies FROM whole
             WHERE said NOT IN (SELECT said FROM cuts) GROUP BY said)
    SELECT conv_id, 0 AS part, len(said) AS turns, copies,
           list_aggregate(list_transform(said, lambda s: '<|im_start|>' || s.r || chr(10) || s.t || '<|im_end|>' || chr(10)),
                          'string_agg', '') AS text
    FROM kept
    """,
)
def op10_chat(spark, sf_dir):
    from logwarden.llm import chat

    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from logwarden.llm import toxicity
    from logwarden.llm.langid import remainder

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    out = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    from pyspark.sql import functions as F

    from logwarden.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.remainder("doc_id", 4) != 2))
    out = langid.predict(docs, model).withColumnRenamed("id", "doc_id")
    held_out = F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query(
    "op1_topk",
    """
    WITH ints AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                  FROM embeddings
                  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op1_topk(spark, sf_dir):
    from pyspark.sql import functions as F

    from logwarden.llm import topk

    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.integer_vector(F.col("embedding")).alias("vector"))
    return topk.search(rows, rows.where("vec_id % 50 = 0"), k=5)


@query("op4_substring_dedup")
def op4_substring_dedup(spark, sf_dir):
    from logwarden.llm import substring_dedup

    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    from logwarden.llm import line_dedup

    return line_dedup.remove_recurring_lines(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query(
    "op13_resampling",
    """
    WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
                           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
    docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    targets AS (SELECT unnest(regexp_extract_all(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
    per_doc AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM docs) GROUP BY r, word),
    vocabulary AS (SELECT word FROM per_doc UNION SELECT word FROM targets),
    coded AS (SELECT word, list_transform(range(1, octet_length(encode(word)) + 1),
                  lambda k: CAST('0x' || substr(hex(encode(word)), 2 * k - 1, 2) AS BIGINT)) AS bytes FROM vocabulary),
    bucketed AS (SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), 4294967295), 4294967295)
                     % 10000 AS bucket FROM coded, crc_table),
    corpus AS (SELECT bucket, sum(n) AS s FROM per_doc JOIN bucketed USING (word) GROUP BY bucket),
    wanted AS (SELECT bucket, count(*) AS t FROM targets JOIN bucketed USING (word) GROUP BY bucket),
    totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus) AS s_all, (SELECT coalesce(sum(t), 0) FROM wanted) AS t_all),
    gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS g
             FROM corpus LEFT JOIN wanted USING (bucket), totals),
    weighed AS (SELECT r, CAST(floor(sum(n * g)::DOUBLE / sum(n)) AS BIGINT) AS weight
                FROM per_doc JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY r),
    scored AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                          / 4294967296))) AS BIGINT) AS score
               FROM docs LEFT JOIN weighed USING (r)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                      count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank
    FROM ranked
    """,
)
def op13_resampling(spark, sf_dir):
    from logwarden.llm import resampling

    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target, percent=10, seed=2024).withColumnRenamed("id", "doc_id")


@query("op11_repair")
def op11_repair(spark, sf_dir):
    from logwarden.llm import repair

    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows), rows)


@query("op12_extraction")
def op12_extraction(spark, sf_dir):
    from logwarden.llm import extraction

    return extraction.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
