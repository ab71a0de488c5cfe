"""The contains-join with a table of patterns against plain search."""

import random
import time

import pytest

from crawlgrain import fixed_values as V
from crawlgrain.operators import job_logs as J, patterns as P


def frame(spark, rows, ddl="id long, text string"):
    return spark.createDataFrame(rows, ddl)


def table(spark, patterns):
    return spark.createDataFrame([(k, p) for k, p in enumerate(patterns)], "priority long, pattern string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def expected(rows, patterns):
    return sorted((i, k) for i, t in rows for k, p in enumerate(patterns) if t is not None and p is not None and p.lower() in t.lower())


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    letters = "aAbBcÉ中\n.*\U0001d538"
    word = lambda n: "".join(rng.choices(letters, k=n))
    rows = [(k, word(rng.randint(0, 60))) for k in range(120)] + [(200, None), (201, ""), (202, "ab"), (203, "a")]
    patterns = [word(rng.choice([1, 2, 2, 3, 4, 5, 6])) for _ in range(80)] + [None, "aB", "Ab", "never found", "a.b", ".*"]
    patterns += [""] if seed else []
    found = P.find_patterns(frame(spark, rows), ["id"], "text", table(spark, patterns))
    assert sorted((r.id, r.priority) for r in found.collect()) == expected(rows, patterns)


def test_rows_that_share_their_keys_and_null_keys(spark):
    rows = [(1, "one apple"), (1, "one pear"), (1, "one pear"), (None, "apple pie"), (None, "plum")]
    found = P.find_patterns(frame(spark, rows), ["id"], "text", table(spark, ["apple", "pear"]))
    assert sorted(((r.id, r.pattern) for r in found.collect()), key=repr) == sorted(
        [(1, "apple"), (1, "pear"), (1, "pear"), (None, "apple")], key=repr)


def test_no_texts_or_patterns(spark):
    assert P.find_patterns(frame(spark, []), ["id"], "text", table(spark, ["abc"])).count() == 0
    assert P.find_patterns(frame(spark, [(1, "abc")]), ["id"], "text", table(spark, [])).count() == 0
    assert P.find_patterns(frame(spark, [(1, "abc")]), ["id"], "text", table(spark, [None])).count() == 0


def test_ten_thousand_patterns_without_a_nested_loop(spark):
    rng = random.Random(7)
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    patterns = ["".join(rng.choices(syllables, k=3)) for _ in range(10_000)]
    rows = [(k, " ".join("".join(rng.choices(syllables, k=4)) for _ in range(60))) for k in range(400)]
    rows += [(1000 + k, f"x{patterns[k * 37]}y") for k in range(200)]
    found = P.find_patterns(frame(spark, rows).repartition(4), ["id"], "text", table(spark, patterns))
    start = time.perf_counter()
    got = sorted((r.id, r.priority) for r in found.collect())
    assert got == expected(rows, patterns) and time.perf_counter() - start < 60
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_rarest_gram_is_chosen(spark):
    texts = frame(spark, [(k, "the common words") for k in range(9)] + [(10, "the zqx")]).withColumnRenamed("text", "_text")
    patterns = spark.createDataFrame([("the zqx", "the zqx"), ("common", "common")], "_pattern string, _text string")
    index, sizes = P.pattern_index(texts, patterns)
    got = {r._pattern: r.gram for r in index.collect()}
    assert sizes == [3] and got["the zqx"] in {" zq", "zqx", "e z"} and got["common"] in {"com", "omm", "mmo", "mon"}


def test_a_long_text(spark):
    rows = [(1, "ab " * 200_000 + "needle" + " cd" * 200_000)]
    found = P.find_patterns(frame(spark, rows), ["id"], "text", table(spark, ["NEEDLE", "missing"]))
    assert [(r.id, r.pattern) for r in found.collect()] == [(1, "NEEDLE")]


def test_errors_and_data_types_as_the_fixed_catalogues_give_them(spark):
    errors = spark.createDataFrame([(k, *p) for k, p in enumerate(V.ERROR_PATTERNS)], "priority long, error_type string, explanation string, recommendation string")
    texts = ["HTTPError: 429 timeout", "nothing", "", None, " and ".join(p[0].upper() for p in V.ERROR_PATTERNS), V.ERROR_PATTERNS[3][0]]
    attempts = spark.createDataFrame([("r", k, t) for k, t in enumerate(texts)], "request_id string, attempt_no int, stderr string")
    key = lambda df: sorted(map(tuple, df.select("request_id", "attempt_no", "ord", "error_type", "explanation", "recommendation").collect()))
    assert key(P.classify_errors_by(attempts, errors)) == key(J.classify_errors(attempts))

    words = [(w, w) for w in V.DATA_TYPES] + [(name, word) for name, ws in V.DATA_TYPE_SYNONYMS for word in ws]
    catalogue = spark.createDataFrame([(k, *w) for k, w in enumerate(words)], "priority long, data_type string, word string")
    wishes = ["A list of products", "prices, reviews and news in multiple lists", "weather", "", "Job posts, profile, comments", *[w for _, w in words]]
    requests = spark.createDataFrame(list(enumerate(wishes)), "request_id long, expected_data string")
    key = lambda df: sorted(map(tuple, df.select("request_id", "ord", "data_type").collect()))
    assert key(P.match_data_types_by(requests, catalogue)) == key(J.match_data_types(requests))
