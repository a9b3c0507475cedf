"""Operators against brute force, round trips and held-out rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logwarden.llm import bpe, langid, line_dedup, mixing, queries, simhash_dedup, simhash_views, substring_dedup, toxicity
from logwarden.llm.common import table

TEXT = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def roots(nodes, pairs):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        low[y] = x
    return {n: find(n) for n in nodes}


def test_bpe_equals_the_library(spark, sf, corpus):
    path = queries.vocabulary_path()
    library = Tokenizer.from_file(path)
    random.seed(1)
    letters = "ab '’stred  \n\t\x85 é漢字1２٣!…<|endoftext|>՘\U00011de0\x1c​😀"
    texts = [t for _, t in corpus]
    texts += ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "a" * 500, "aaaa " * 50, " a", "a\n b", "don't 'll", "\n " * 7, "<|endoftext|>", " <|endoftext|> a"]
    rows = list(enumerate(texts))
    out = bpe.encode_and_decode(spark.createDataFrame(rows, TEXT), path).collect()
    want = library.encode_batch(texts, add_special_tokens=False)
    for r in out:
        assert r["ids"] == want[r["id"]].ids
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    digests = {r["id"]: r for r in bpe.digests(spark.createDataFrame(rows, TEXT), path).collect()}
    assert all(digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, w.ids)).encode()).hexdigest() for i, w in enumerate(want))
    assert all(digests[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)


def test_simhash_query(spark, sf, corpus):
    def fingerprint(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
        runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in corpus}
    ids = sorted(prints)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2]
    low = roots(ids, near)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op6_simhash"](spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", low[i]) for i in ids}


@pytest.mark.parametrize("chosen,limit", [(None, 64), (None, 8), ([(list(range(32)), 1), (list(range(32, 64)), 0)], 64)])
def test_links_of_crowded_cells(spark, chosen, limit):
    random.seed(5)
    values = {random.getrandbits(64) for _ in range(60)}
    for base in list(values)[:12]:
        for _ in range(random.choice([2, 60])):
            x = base
            for bit in random.sample(range(64), random.choice([1, 1, 2, 2, 3])):
                x ^= 1 << bit
            values.add(x)
    values = sorted(simhash_dedup.signed(v) for v in values)
    near = [(a, b) for k, a in enumerate(values) for b in values[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    low = roots(values, near)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = dict(simhash_dedup.components(simhash_dedup.links(fps, 2, chosen, limit)).collect())
    assert got == {v: r for v, r in low.items() if v != r}


def test_thresholds_add_up(spark):
    random.seed(2)
    fps = spark.createDataFrame([(simhash_dedup.signed(random.getrandbits(64)),) for _ in range(300)], "fp long")
    for radius in (0, 1, 2, 3):
        chosen = simhash_dedup.plan(fps, radius)
        assert sum(t + 1 for _, t in chosen) == radius + 1
        assert len({b for bits, _ in chosen for b in bits}) == sum(len(bits) for bits, _ in chosen)


def test_near_copies_at_a_similarity(spark, corpus):
    random.seed(7)
    texts = [t for _, t in corpus if len(t.split()) > 60][:40]
    rows = list(enumerate(texts))
    for t in texts[:20]:
        for _ in range(6):
            words = t.split()
            for _ in range(max(1, len(words) // 60)):
                words[random.randrange(len(words))] = f"new{random.random()}"
            rows.append((len(rows), " ".join(words)))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    low = roots(sets, near)
    df = spark.createDataFrame(rows, TEXT)
    got = {r["id"]: r["group_id"] for r in simhash_views.mark_groups(df).collect()}
    assert got == low and len(set(low.values())) < len(rows) - 60
    assert sorted(r["doc_id"] for r in simhash_views.drop_near_duplicates(df).collect()) == sorted(set(low.values()))


@pytest.mark.parametrize("window", [16, 50])
def test_repeated_passages(spark, corpus, window):
    random.seed(3)
    passages = [" ".join(f"p{k}_{j}" for j in range(random.randint(window, 3 * window))) for k in range(5)]
    rows = []
    for i, t in corpus:
        words = t.split()
        if i % 3 == 0:
            at = random.randint(0, len(words))
            words[at:at] = random.choice(passages).split()[random.randint(0, 4) :]
        rows.append((i, " ".join(words)))
    rows += [(9000, "x " * 400), (9001, "x " * 300), (9002, "y x " * 200)]
    words = {i: t.encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    got = {r["id"]: tuple(r)[1:] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, TEXT), window).collect()}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        kept = b" ".join(x for x, y in zip(w, keep) if y)
        assert got[i] == (len(w), keep.count(False), hashlib.sha256(kept).hexdigest())


def test_recurring_lines(spark, corpus):
    random.seed(4)
    rows = []
    for i, t in corpus:
        lines = t.split("\n")
        if i % 4 == 0:
            lines.insert(0, f"job {i} finished in {random.randint(1, 99)} seconds on host h{i}")
        if i % 5 == 0:
            lines.append(f"All rights are reserved by owner{chr(97 + i % 26)} of this page")
        rows.append((i, "\n".join(lines)))
    got = {r["id"]: r for r in line_dedup.remove_recurring_lines(spark.createDataFrame(rows, TEXT)).collect()}

    assert_lines(rows, got)
    assert all(not any(x.startswith("job ") for x in t.split("\n")) or got[i]["n_removed"] for i, t in rows)


def assert_lines(rows, got):
    """The rule of line dedup, document by document and place by place."""

    def tokens(line):
        raw = [w for w in line.encode().decode("latin-1").split(" ") if w.strip()]
        shown = ["<*>" if any(c in "0123456789" for c in w) else w for w in raw]
        if len(raw) <= 3 or 2 * (len(raw) - shown.count("<*>")) < len(raw):
            return tuple("=" + w for w in raw), True
        return tuple(shown), False

    def leaf(k, whole):
        return len(k), k if whole else k[:3]

    lines = {i: [tokens(x) for x in t.split("\n")] for i, t in rows}
    reach, having = defaultdict(set), defaultdict(set)
    for i, ls in lines.items():
        for k, whole in ls:
            if k:
                reach[leaf(k, whole)].add(i)
                for p, w in enumerate(k[3:]):
                    having[leaf(k, whole), p, w].add(i)

    def templates(k, whole):
        at, out = leaf(k, whole), set()
        if not k or len(reach[at]) < 3:
            return out
        for least in (3, max(3, 0.1 * len(reach[at]))):
            shown = tuple(w if len(having[at, p, w]) >= least else None for p, w in enumerate(k[3:]))
            kept = sum(w not in (None, "<*>") for w in shown)
            if 2 * kept >= len(shown) and (kept >= 2 or kept == len(shown)):
                out.add((at, shown))
        return out

    spread = defaultdict(set)
    for i, ls in lines.items():
        for x in ls:
            for made in templates(*x):
                spread[made].add(i)
    for i, t in rows:
        kept = [x for x in t.split("\n") if all(len(spread[made]) < 3 for made in templates(*tokens(x)))]
        assert got[i]["n_removed"] == len(t.split("\n")) - len(kept)
        assert got[i]["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_unique_and_short_lines(spark):
    unique = ["I want to leave now", "I want to sleep soundly", "I want to know why", "I want to eat apples", "I want to win twice",
              "I want to swim far", "There was once a brave king", "There was once a small dog", "There was once a green hill",
              "There was once a cold river", "It is 5", "It is 7", "It is 9"]
    rows = [(k, x) for k, x in enumerate(unique)] + [(100 + k, f"Read more\nown text number{chr(97 + k)} here\n\nSign in") for k in range(5)]
    rows += [(200 + k, f"Posted in the news section by author{chr(97 + k)}") for k in range(4)]
    got = {r["id"]: r for r in line_dedup.remove_recurring_lines(spark.createDataFrame(rows, TEXT)).collect()}
    assert all(got[k]["n_removed"] == 0 for k in range(len(unique)))
    assert all(got[100 + k]["n_removed"] == 2 for k in range(5))
    assert all(got[200 + k]["n_removed"] == 1 for k in range(4))
    assert_lines(rows, got)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_on_held_out_rows(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    got = queries.QUERIES["op3_language_id"](spark, sf).collect()
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_language_spans(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit(docs)
    parts = {r["lang"]: r["text"] for r in docs.where("n_chars > 600").collect()}
    a, b = sorted(parts)[:2]
    first, second = (" ".join(langid.words_of(parts[x])[:60]) for x in (a, b))
    spans = langid.spans(spark.createDataFrame([(1, f"{first} {second} {first}")], TEXT), model).first()["spans"]
    assert [s["lang"] for s in spans] == [a, b, a]
    assert all(abs(s["words"] - 60) <= 6 for s in spans)


def test_language_scripts(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("кот и собака дома", "ru")] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    new = spark.createDataFrame([(1, "собачка"), (2, "doggie"), (3, "漢字")], TEXT)
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.predict(new, langid.fit(docs)).collect()}
    assert got[1] == ("ru", 1.0) and got[2] == ("en", 1.0) and got[3][1] == 0.0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    got = queries.QUERIES["op2_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    toxic = [r["score"] for r in held if truth[r["doc_id"]]]
    clean = [r["score"] for r in held if not truth[r["doc_id"]]]
    assert sum(a > b for a in toxic for b in clean) >= 0.93 * len(toxic) * len(clean)


def test_toxicity_without_a_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], TEXT)
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r["score"] > 0.9 for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()] == [True, True]
    assert {round(r["score"], 3) for r in toxicity.score(docs, toxicity.fit(docs, one.limit(0))).collect()} == {0.5}


@pytest.mark.parametrize("hot", [False, True])
def test_mix_meets_its_targets(spark, sf, hot):
    docs = table(spark, sf, "documents")
    if hot:
        same = spark.range(2000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("a few words here").alias("text"), F.lit("hot").alias("source"))
        docs = docs.select("doc_id", "text", "source").unionByName(same)
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    sources = sorted({r["source"] for r in rows})
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in full} if full else share
        open_ -= full or open_
    for s in sources:
        mine = [r for r in rows if r["source"] == s]
        assert {round(r["target"], 4) for r in mine} == {round(target[s], 4)}
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(0.03 * target[s], min(r["size"] for r in mine if r["size"]))


def test_pipeline_links_near_copies_by_fingerprints(spark, sf, corpus):
    """The stage drops what the fingerprints' links connect, by GPH; an id may name several texts or none."""
    rows = [*corpus, (None, "a text of its own words without an id"), (None, "other words that have no id as well")]
    rows += [(10_000_000 + i, f"{t} tail") for i, t in corpus[::3]]
    rows += [(corpus[0][0], "an id that comes twice with another text here")]
    df = spark.createDataFrame(rows, TEXT)
    prints = [r[0] & (2**64 - 1) for r in simhash_dedup.fingerprints(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], TEXT)).orderBy("id").select("fp").collect()]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    low = roots(list(range(len(rows))), near)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(low[k], []).append(i)
    want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    got = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) < len(rows)


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in out}
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert ids <= set(docs) and len({docs[i].lower() for i in ids}) == len(ids)
    assert all(r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() for r in out)
