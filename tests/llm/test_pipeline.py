import random
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import decontaminate, pii, queries

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import brute_near  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    order = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, con.sql(queries.SQL[name]).select(*order).fetchall()))


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").persist()
    scored = {r.doc_id for r in queries.op9_toxicity(spark, FOLDER).filter("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.schema.names == docs.schema.names
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        if name == "toxicity":
            assert set(ids) == {r.doc_id for r in docs.collect()} - scored
        if name == "decontamination":
            left = decontaminate.digest(out, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
            assert left.filter("contaminated").isEmpty()
        if name == "personal_data":
            assert out.filter(F.col("text").contains("@mail")).isEmpty()


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert set(got.columns) >= {"doc_id", "sequence_id", "offset", "length"} and got.count() > 100


def odd_rows():
    """Null and empty texts, null keys, repeated rows, one key with two texts, a toxic word, a benchmark passage, personal data."""
    r = random.Random(3)
    w = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    base = [f"b{i}" for i in range(60)]
    rows = [(i, w(40) + (" snorkwad" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, w(30)), (None, None), (303, w(20)), (303, w(20)), (304, w(25)), (304, rows[3][1])]
    for i in range(310, 330):
        t = list(base)
        for p in r.sample(range(60), r.randrange(4)):
            t[p] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(310, rows[-20][1]), (340, "passage " + " ".join(f"q{i}" for i in range(20)) + " end"), (341, "mail a.b@c.de or 4111 1111 1111 1111 " + w(20))]
    return rows


def odd_docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", 7, i % 2, "x") for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, n_chars long, _row long, spans string")


def test_stages_on_odd_rows_equal_brute_force(spark, tmp_path):
    rows = odd_rows()
    docs = odd_docs(spark, rows)
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (300, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(f"q{i}" for i in range(20))), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: stages[name](spark, docs, str(tmp_path)).collect()
    pairs = lambda out: sorted(((r.doc_id, r.text) for r in out), key=repr)

    assert pairs(left("toxicity")) == sorted(((k, t) for k, t in rows if "snorkwad" not in (t or "")), key=repr)

    text = {}
    for k, t in rows:
        text[k] = t if text.get(k) is None else min(text[k], t or text[k])
    want = brute_near([(k, t) for k, t in text.items() if k is not None], 80)
    kept = [(k, text[k]) for k, (_, c) in want.items() if c == k] + [(k, t) for k, t in rows if k is None]
    assert pairs(left("near_duplicates")) == sorted(kept, key=repr)
    assert sum(310 <= (k or 0) < 330 for k, _ in kept) < 20

    found = decontaminate.brute_force([t for _, t in rows], items)
    clean = [row for row, (n, hit, _) in zip(rows, found, strict=True) if not (hit and 20 * hit >= n)]
    assert pairs(left("decontamination")) == sorted(clean, key=repr) and len(clean) == len(rows) - 1

    hidden = [(k, t if not t else pii.masked(t, sum(pii.all_spans(t), []))) for k, t in rows]
    out = left("personal_data")
    assert pairs(out) == sorted(hidden, key=repr) and all(r.n_chars == len(r.text) for r in out if r.text is not None)

    packed = left("packing")
    assert Counter(r.doc_id for r in packed) == Counter(k for k, _ in rows)
    for name, stage in stages.items():
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
