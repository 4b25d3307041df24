import random
import time

import pytest

from loomspark.llm import passages, pii, quality, queries, suffixes, tokens, toxicity, warc
from loomspark.llm.text import groups_for

M = 1_000_000
TEXTS = {
    "blanks": "x (at) y" + " " * M,
    "word": "one two " + "a" * M,
    "line of words": "word and the " * (M // 13),
    "digits": "one two " + "1" * M,
    "disguises": "a at b dot " * (M // 11),
    "addresses": "а@b.com a@b.cd " * (M // 15),
    "brackets": "( " * (M // 2) + "(at)",
    "numbers": "1.1.1.1 1 dot 1 one two plus 1 " * (M // 31),
}


@pytest.mark.parametrize("name", list(TEXTS))
def test_patterns_are_linear(name):
    text = TEXTS[name]
    took = []
    for part in (text[: M // 4], text):
        began = time.process_time()
        pii.all_spans(part)
        took.append(time.process_time() - began)
    assert took[1] < 12 and took[1] < 4 * 2.5 * max(took[0], 0.2)  # quadratic would be 16 times


def test_long_texts_go_through(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS.values())], "doc_id long, text string").repartition(4)
    assert pii.digest(df).count() == len(TEXTS)
    words = {r.doc_id: r.n_words for r in quality.digest(df).collect()}
    assert words == {i: len(t.split()) for i, t in enumerate(TEXTS.values())}
    pages = df.selectExpr("doc_id AS page_id", "'http://a/' AS url", "text AS html")
    sizes = {r.page_id: r.payload_bytes for r in warc.round_trip(pages).collect()}
    assert sizes == {i: len(t.encode()) for i, t in enumerate(TEXTS.values())}
    import public_tokenizers

    counts = tokens.by_section(df.filter("doc_id IN (2, 4)"), queries.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="first")
    assert counts.count() == 2
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    some = spark.createDataFrame([(i, "you vile fool" if i % 2 else "a kind word") for i in range(8, 40)], "doc_id long, text string")
    scored = toxicity.toxicity(df.unionByName(some), labels).collect()
    assert len(scored) == len(TEXTS) + 32 and all(0 <= r.score <= 1 for r in scored)


@pytest.mark.parametrize("size", ["64m", "64MB", "1048576b", "1g", "500000"])
def test_any_arrow_setting(spark, size):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, size)
        df = spark.createDataFrame([(1, "mail joe@example.com")], "doc_id long, text string")
        assert pii.digest(df).first().n_email == 1
    finally:
        spark.conf.set(name, before)


def test_groups_follow_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(64)], "doc_id long, text string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert groups_for(df, "text") == least and groups_for(df, "text", per=1000) == 64 and groups_for(df.limit(0), "text") == least


def test_results_do_not_depend_on_the_number_of_groups(spark, monkeypatch):
    r = random.Random(2)
    words = [f"{r.choice('bcdfg')}{i}" for i in range(900)]
    shared = " ".join(r.choice(words) for _ in range(70))
    rows = [(i, " ".join(r.choice(words) for _ in range(60)) + (" " + shared if i % 3 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: (sorted(map(tuple, suffixes.digest(df).collect())), sorted(map(tuple, passages.near_duplicate_passages(df).collect())))
    few = run()
    reached = {}
    for doc, *_, component in few[1]:  # all hold one passage, whose first document is 0
        reached[doc] = component
    assert set(reached.values()) == {0} and len(reached) == 19
    for module in (suffixes, passages):
        monkeypatch.setattr(module, "groups_for", lambda docs, text: 37)
    assert run() == few and len(few[1]) >= 19 and sum(x[2] > 0 for x in few[0]) == 19
