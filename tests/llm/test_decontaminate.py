"""Items found against an edit distance over whole small texts."""

import random
import tracemalloc

import numpy as np

from crawlgrain.llm import decontaminate as D


def distance(item, text):
    """Least edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def damaged(rng, text, edits, signs):
    out = list(text)
    for _ in range(edits):
        k, how = rng.randrange(len(out)), rng.choice("sid")
        if how == "s":
            out[k] = rng.choice(signs)
        elif how == "i":
            out.insert(k, rng.choice(signs))
        elif len(out) > 1:
            del out[k]
    return "".join(out)


def test_search_is_the_edit_distance():
    rng = random.Random(5)
    hits = 0
    for _ in range(500):
        signs = rng.choice(["ab", "abc def", "abcdefghij "])
        item = "x" + "".join(rng.choices(signs, k=rng.randint(8, 60))) + "y"
        text = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        text += damaged(rng, item, rng.randint(0, len(item) // 7), signs) + "".join(rng.choices(signs, k=rng.randint(0, 40)))
        items = D.Items([1], [item])
        k = int(items.budget[0])
        edits = distance(D.fold(item).tolist(), D.fold(text).tolist())
        assert items.search([None, text, ""]) == ([(1, 0, edits)] if edits <= k else [])
        hits += edits <= k
    assert 100 < hits < 500


def test_memory_follows_hits_not_texts_times_items():
    """40,000 items and 10,000 lines in one slice: the counts of all pairs would take 3 GB."""
    rng = random.Random(1)
    items = D.Items(list(range(40_000)), ["".join(rng.choices("abcdefghijklmnop", k=24)) for _ in range(40_000)])
    lines = [f"line {k}" for k in range(10_000)]
    lines[77] = "see " + items.codes[123].tobytes().decode("utf-32-le")
    tracemalloc.start()
    got = items.search(lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(77, 123, 0)] and peak < 300 << 20


def test_parts_of_long_items_are_found():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**5)}" for _ in range(400)]
    item = " ".join(words)
    half, stray = " ".join(words[150:260]), " ".join(words[150:175])
    items = D.Items([5], [item])
    assert items.search([f"before {half} after", stray, item]) == [(0, 0, 0), (2, 0, 0)]
    ((row, _, edits),) = items.search([damaged(rng, half, 12, "xyz")])
    assert row == 0 and 0 < edits <= D.PASSAGE * D.EDITS // 100
    parts = D.passages(D.fold(item))
    assert all(len(p) == D.PASSAGE for p in parts) and np.array_equal(np.concatenate([parts[0], parts[-1]])[: D.PASSAGE], D.fold(item)[: D.PASSAGE])


def test_short_items_are_whole_words():
    items = D.Items([1, 2, 3, 4], ["Yes", "a+b", "", "中文"])
    assert sorted(items.search(["well, yes!", "yesterday", "x a+b y", "中文 ok", "a+bc", None])) == [(0, 0, 0), (2, 1, 0), (3, 3, 0)]


def test_a_very_long_text(docs_of, spark):
    item = "the one question that nobody should train a model on, ever again"
    docs = docs_of((1, "some words " * 150_000 + item + " and words" * 150_000), (2, "some words " * 150_000))
    got = D.find_items(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 9, 0)]


def test_small_parts_count_alike(monkeypatch):
    item, text = "a" * 40, "b" + "a" * 300 + "c"
    want = D.Items([1], [item]).search([text])
    monkeypatch.setattr(D, "_HITS", 50)
    assert D.Items([1], [item]).search([text]) == want == [(0, 0, 0)]


def test_case_and_white_space():
    item = "Some  Long\nbenchmark Question, with an ANSWER"
    assert D.Items([7], [item]).search([f"...\t{item.upper()}\n", f"x {item.replace(' ', '   ')} y"]) == [(0, 0, 0), (1, 0, 0)]
    assert np.array_equal(D.fold(" A  b "), D.fold("a B"))


def test_query(spark, table):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**5)}" for _ in range(4000)]
    items = [(k, " ".join(words[40 * k : 40 * k + 30])) for k in range(20)] + [(90, None), (91, ""), (92, "short"), (1, None), (93, " ".join(words[:30]))]
    clean = " ".join(words[1000:1400])
    rows = [(10, f"{clean} {items[3][1]} {clean}"), (11, clean), (12, damaged(rng, items[4][1], 8, "xyz") + clean), (13, None), (14, ""),
            (15, items[0][1]), (15, items[0][1]), (None, items[5][1]), (16, items[6][1][:90] + clean)]
    got = sorted(((r.doc_id, r.item_id) for r in D.op5_decontaminate(spark, table(*rows, benchmark=items)).collect()), key=repr)
    assert got == sorted([(10, 3), (12, 4), (15, 0), (15, 0), (15, 93), (15, 93), (None, 5)], key=repr)


def test_blocks_of_items_find_the_same(spark, docs_of):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(20)) for _ in range(12)]
    docs = docs_of(*[(k, f"before {t} after") for k, t in enumerate(texts)])
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    whole = sorted(map(tuple, D.find_items(docs, items).collect()))
    assert sorted(map(tuple, D.find_items(docs, items, block_chars=300).collect())) == whole == [(k, k, 0) for k in range(12)]


def test_contaminated_documents_go(spark, docs_of):
    items = spark.createDataFrame([(1, "the question of all the questions, asked once")], "item_id long, text string")
    docs = docs_of((1, "so: The question of all the questions, asked once!"), (2, "nothing"), (3, None)).selectExpr("*", "1 AS item_id", "2 AS edits")
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert D.drop_contaminated(docs, items.limit(0)).count() == 3
    assert D.find_items(docs_of(), items).collect() == []
