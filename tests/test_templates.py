"""Golden rows of the masking chain."""

import random
import re

from pyspark.sql import functions as F

from logwarden.functions.text import MASKS
from logwarden.operators.templates import add_template, normalize

GOLDEN = [
    ("Denied 172.16.4.9 for 123e4567-e89b-12d3-a456-426614174000", "Denied <IP> for <UUID>"),
    ("Seen at 2023-11-02T01:02:03.456Z by 10.1.2.3", "Seen at <TIMESTAMP> by <IP>"),
    ("Feb  3 started; Mar 14 01:59:26 host up", "Feb 3 started; <TIMESTAMP> host up"),
    ("GET 14/Mar/2023:01:59:26 +0100 done", "GET <TIMESTAMP> done"),
    ("took 37ms and 1.5 GiB", "took <DURATION> and <SIZE>"),
    ("waited 450μs then 12 sec", "waited <DURATION> then <DURATION>"),
    ("call https://api.shop.example/pay?id=9 ok", "call <URL> ok"),
    ("sha deadbeefdeadbeefdeadbeefdeadbeef built", "sha <HEX_HASH> built"),
    ("peer fe80:0000:0000:0000:0202:b3ff:fe1e:8329 lost", "peer <IPV6> lost"),
    ("user usr_beef1234 kept, 0x7ffe dropped", "user usr_beef1234 kept, <HEX_ID> dropped"),
    ("span cafe1234 done", "span <HEX_ID> done"),
    ("load=93.5% now", "load=<PCT> now"),
    ("nothing volatile here", "nothing volatile here"),
    ("error in /srv/app/main.conf line 12", "error in <PATH> <NUM_ID>"),
    ("mail to a.b+c@mail.example.org sent", "mail to <EMAIL> sent"),
    ("bind port: 443 failed", "bind port=<PORT> failed"),
    ("user_id=42 attempt 3 status_code: 500", "<NUM_ID> <NUM_ID> <NUM_ID>"),
    # A lone colon between word characters counts as a compressed address.
    ("a:b", "a<IPV6>b"),
    ("10.0.0.1:8080 up", "<IP><IPV6>8080 up"),
    # Addresses are masked before URLs.
    ("http://10.0.0.1:8080/health", "<URL>><IPV6>8080/health"),
    # A bare run of 10 to 13 digits is hexadecimal first, 16 and more a hash.
    ("t 1700000000 x", "t <HEX_ID> x"),
    ("t_1700000000 x", "t_<TIMESTAMP> x"),
    ("n 1234567 x", "n <NUM_ID> x"),
    ("h 1234567890123456 x", "h <HEX_HASH> x"),
    # Unicode digits and whitespace.
    ("　value ١٢٣٤٥٦٧ ok ", "value <NUM_ID> ok"),
    ("tab\tkept  spaces   squeezed ", "tab\tkept spaces squeezed"),
]


def test_golden_rows(spark):
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(GOLDEN)], "id int, message string")
    got = {r["id"]: r["normalized_message"] for r in add_template(rows).collect()}
    wrong = [(GOLDEN[i], got[i]) for i in got if got[i] != GOLDEN[i][1]]
    assert not wrong, wrong


def test_full_form_agrees_and_counts(spark):
    rows = spark.createDataFrame([(m,) for m, _ in GOLDEN], "message string")
    out = normalize(add_template(rows, name="short"))
    assert out.filter(F.col("short") != F.col("normalized_message")).count() == 0
    by = {r["message"]: r for r in out.collect()}
    one = by["Seen at 2023-11-02T01:02:03.456Z by 10.1.2.3"]
    assert one["token_counts"] == {"<TIMESTAMP>": 1, "<IP>": 1}
    assert one["total_replacements"] == 2 and one["changed"]
    plain = by["nothing volatile here"]
    assert plain["token_counts"] == {} and not plain["changed"]
    assert by["tab\tkept  spaces   squeezed "]["changed"]


def test_filter_on_template_keeps_the_plan_small(spark):
    rows = spark.createDataFrame([(m,) for m, _ in GOLDEN], "message string")
    out = add_template(rows).filter(F.col("normalized_message").contains("<IP>")).filter("length(normalized_message) > 3")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 60_000
    assert out.count() == 3


def by_python(message):
    """The same steps with Python's regular expressions."""
    for mask in MASKS:
        pattern = mask.pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
        message = re.sub(pattern, mask.label, message)
    return re.sub(" {2,}", " ", message).strip()


def random_messages(n):
    rng = random.Random(11)
    pieces = [
        "10.0.0.1", "::1", "a:b", "fe80::", "1.2.3.4/24", "256.1.1.1", "user@x.io", "http://h/p?q=1", "/var/log/a.b", "//x",
        "12ms", "3.4 GB", "45%", "port=80", "port 8080", "0xff", "deadbeef", "1700000000", "x1700000000y", "pid=7", "line 3",
        "2024-01-15T12:34:56Z", "2024-01-15 12:34:56,123+0100", "Jan 5 01:02:03", "{123e4567-e89b-12d3-a456-426614174000}",
        "é", "ß", "١٢٣", "\u00a0", "\u2003", "\t", "  ", " ", "=", ":", "-", "_", "(", ")", "<", ">", "µs", "9μs", "K", "word",
    ]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_same_as_python_regex(spark, sf):
    texts = [m for m, _ in GOLDEN] + random_messages(4000)
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = spark.createDataFrame([(t,) for t in texts], "message string")
    got = {r["message"]: r["normalized_message"] for r in add_template(rows).collect()}
    wrong = [(t, got[t], by_python(t)) for t in set(texts) if got[t] != by_python(t)]
    assert not wrong, (len(wrong), wrong[:3])
