import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import conversations, exact, queries, ranked

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_conversation_repair", "op13_exact_dedup"])
def test_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, FOLDER), duck.sql(queries.SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, want.select(*order).fetchall()))


# ---- 11


def brute_search(rows, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    total, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(x for _, c in docs for x in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m)) for x in terms(text) if x in c)
            scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(map(repr, out))


def test_search_against_brute_force(spark):
    r = random.Random(5)
    common, rare = [f"w{i}" for i in range(8)], [f"r{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.8 else r.choice(rare) for _ in range(n))
    rows = [(i, text(r.randrange(1, 60))) for i in range(400)]
    rows += [(1000 + i, rows[3][1].upper()) for i in range(30)] + [rows[7]] * 3
    rows += [(500, None), (501, ""), (502, " .,- "), (None, rows[9][1]), (503, "Ünï 漢字 w1 \U0001f600"), (504, text(30_000))]
    items = [(i, text(12)) for i in range(20)] + [(20, None), (21, "..."), (22, "never met"), (None, "w1 r5 r5"), (23, rows[3][1]), (23, "漢字 ÜNÏ ünï"), (24, "r1 " * 40)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, terms string").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    want = brute_search(rows, items, 10)
    assert sorted(map(repr, map(tuple, ranked.search(df, q).collect()))) == want
    assert sorted(map(repr, map(tuple, ranked.search(df, q, block=300).collect()))) == want
    assert sorted(map(repr, map(tuple, ranked.search(df, q, item_bytes=600).collect()))) == want
    assert sorted(map(repr, map(tuple, ranked.search(df, q, k=3).collect()))) == brute_search(rows, items, 3)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranked.search(none, item).collect() == []
    assert ranked.search(none.unionByName(spark.createDataFrame([(1, "one two")], none.schema)), item.limit(0)).collect() == []


def test_postings_are_left_once_the_top_is_proven():
    rng = np.random.default_rng(2)
    n_docs, n_terms = 4000, 50
    has = rng.random((n_docs, n_terms)) < np.linspace(0.001, 0.9, n_terms)
    first = np.concatenate([[0], np.cumsum(has.sum(1))])
    terms = np.nonzero(has)[1].astype(np.int64)
    tfs = rng.integers(1, 5, len(terms))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * has.sum(0) + 1))).astype(np.int64)
    n = rng.integers(50, 400, n_docs)
    items = ranked.Items([], np.zeros(0, np.uint64), None, None, None, [np.sort(rng.choice(n_terms, 12, replace=False)) for _ in range(20)], [np.ones(12, np.int64)] * 20)
    run = lambda candidates: ranked.rank_block(n, first, terms, tfs, np.arange(n_docs), weights, n_docs, int(n.sum()), items, 10, candidates)
    early, whole = run(128), run(-1)
    for a, b in zip(early[:3], whole[:3], strict=True):
        assert [x.tolist() for x in a] == [x.tolist() for x in b]
    every = sum(int(has[:, t].sum()) for own in items.terms for t in own if weights[t])
    assert whole[3] == every and early[3] < 0.5 * every


# ---- 12

STATES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(signature):
    """(cost, audit, roles) by looking at every sequence of edits with up to two inserts before a turn."""
    best = None

    def go(i, state, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(signature):
            for n in range(3):
                if state in (0, 3) and (best is None or (cost + 2 * n, audit + "I" * n) < best):
                    best = (cost + 2 * n, audit + "I" * n)
                state = 3 if state == 2 else 2
            return
        for n in range(3):
            c, a, mark = cost + 2 * n, audit + "I" * n, signature[i]
            go(i + 1, state, c + 3, a + "D")
            if mark != "-":
                late = int(mark.isupper())
                if mark.lower() in STATES[state]:
                    go(i + 1, STATES[state][mark.lower()], c + late, a + "K")
                go(i + 1, 3 if state == 2 else 2, c + 2 + late, a + "R")
            state = 3 if state == 2 else 2

    go(0, 0, 0, "")
    return best[1], best[0]


def test_trie_finds_the_cheapest_edits_and_shares_layers():
    marks = "suaoSUAO-"
    every = sorted("".join(p) for n in range(4) for p in itertools.product(marks, repeat=n))
    r = random.Random(4)
    every += sorted({"".join(r.choice(marks + "uaua") for _ in range(r.randrange(4, 7))) for _ in range(150)})
    trie = conversations.Trie()
    for x in every:
        assert trie.solve(x) == cheapest(x), x
    assert trie.solve(every[-1]) == conversations.Trie().solve(every[-1])
    shared = conversations.Trie()
    for x in every[:820]:  # all of up to three turns: each prefix is a node
        shared.solve(x)
    assert shared.nodes == 9 + 81 + 729


def test_long_conversations_are_linear():
    trie = conversations.Trie()
    audit, cost = trie.solve("ua" * 100_000)
    assert cost == 0 and audit == "K" * 200_000
    audit, cost = trie.solve("-" * 100_000)
    assert cost == 300_000 and set(audit) == {"D"}
    assert conversations.layer.cache_info().currsize < 2000


def brute_repair(rows):
    """What the contract says, conversation by conversation, with ``cheapest``-like edits from an own search."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        seen, marks, count = set(), "", Counter()
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none"
            seen.add((role, text))
            count[fault] += 1
            mark = role[:1] if role[:1] in ("s", "u", "a") else "o"
            marks += "-" if fault in ("blank", "duplicate") else mark.upper() if fault == "truncated" else mark
        audit, cost = cheapest(marks) if len(marks) < 6 else conversations.Trie().solve(marks)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        state, at, done = 0, 0, []
        for letter in audit:
            if letter == "I":
                state = 3 if state == 2 else 2
                done.append({2: "user", 3: "assistant"}[state] + ":")
                continue
            if letter == "K":
                state = STATES[state][own[at][1][0]]
                done.append(own[at][1] + ":" + own[at][2])
            elif letter == "R":
                state = 3 if state == 2 else 2
                done.append({2: "user", 3: "assistant"}[state] + ":" + own[at][2])
            at += 1
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return out


def test_repair_against_brute_force(spark):
    r = random.Random(8)
    text = lambda: r.choice(["Hello there.", "what?", "cut off", "ends!  \n", " ", "", None, "é 漢 . x", "...", " ", "Hello there."])
    rows = []
    for conv in [*range(150), None]:
        for turn in range(r.randrange(1, 6)):
            rows.append((conv, r.choice([turn, turn, turn + 3, None, 2]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]), text()))
    rows += [(200, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(900)]
    rows += [(201, 4, "user", "x" * 1_200_000 + ".")] + [(202, t, "user", "same.") for t in range(50)]
    rows += [rows[0], rows[3], rows[3]]
    df = spark.createDataFrame([(*x, "y", 2) for x in rows], "conv_id long, turn long, role string, text string, audit string, head int").repartition(5)
    got = conversations.digest(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_repair(rows)))
    heads = {x.conv_id: x for x in got.filter("conv_id IS NOT NULL").collect()}
    turns = {}
    for x in conversations.repaired(conversations.damaged(df)).filter("conv_id IS NOT NULL").collect():
        turns.setdefault(x.conv_id, []).append((x.position, f"{x.role}:{x.text}"))
    for conv, head in heads.items():
        own = sorted(turns.get(conv, []))
        assert [p for p, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest() == head.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for _, t in own))


def test_repair_of_dropped_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.digest(spark.createDataFrame([(dropped, 0, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.digest(spark.createDataFrame([], schema)).collect() == []


# ---- 13


def brute_exact(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, stays = hashlib.sha256(t.encode()).hexdigest(), ids.index(keep)
        out += [(i, keep, len(ids), at == stays, sha) for at, i in enumerate(ids)]
    return sorted(map(repr, out))


ODD = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "abc"), (None, "only"), (None, "ONLY"), (7, "x" * 1_200_000), (8, "X" * 1_200_000), (9, "İ"), (9, "i̇"), (2, "abc"), (10, " abc"), (10, " abc")]


def write(spark, rows, folder, files=1):
    spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, file string, row int").repartition(files).write.mode("append").parquet(str(folder))


def verdicts(found):
    return sorted(repr((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex())) for r in found.collect())


def test_exact_dedup_of_odd_rows(spark, tmp_path):
    write(spark, ODD, tmp_path / "d")
    assert sorted(map(repr, map(tuple, exact.digest(spark, str(tmp_path / "d")).collect()))) == brute_exact(ODD)
    kept = exact.ExactDedup(spark, str(tmp_path / "d"), str(tmp_path / "s")).advance().deduplicated()
    assert kept.columns == ["doc_id", "text", "file", "row"] and kept.count() == len({(t or "").lower() if (t or "").isascii() else t for _, t in ODD})
    write(spark, [], tmp_path / "none")
    assert exact.digest(spark, str(tmp_path / "none")).collect() == []


def test_exact_dedup_goes_on_where_it_was(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, f"text {r.randrange(60)}") for i in range(300)] + [(1000 + i, "everywhere") for i in range(200)]
    write(spark, rows[:350], tmp_path / "d", 6)
    run = exact.ExactDedup(spark, str(tmp_path / "d"), str(tmp_path / "s"), batch_bytes=2000)
    assert verdicts(run.advance().verdicts()) == brute_exact(rows[:350])
    batches = lambda: len(list((tmp_path / "s" / "state" / "commits").glob("[0-9]*")))
    first = batches()
    assert first > 1
    write(spark, rows[350:], tmp_path / "d", 3)
    again = exact.ExactDedup(spark, str(tmp_path / "d"), str(tmp_path / "s"), batch_bytes=2000)  # another session's: all it knows is in the folder
    assert verdicts(again.advance().verdicts()) == brute_exact(rows)
    assert batches() > first
    read = {x["n"] for x in again.state().filter("n > 100").collect()}
    assert read == {200}


def test_exact_dedup_tells_texts_of_one_digest_apart(spark, tmp_path):
    rows = ODD[:6] + [(20 + i, f"t{i % 7}") for i in range(40)]
    write(spark, rows, tmp_path / "d", 2)
    weak = exact.ExactDedup(spark, str(tmp_path / "d"), str(tmp_path / "s"), digest=lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1)))
    got = sorted(repr((r.id, r.keep_id, r.group_size, r.kept)) for r in weak.advance().verdicts().collect())
    want = sorted(repr(eval(x)[:4]) for x in brute_exact(rows))
    assert weak.state().count() < 14 and got == want


def test_exact_dedup_of_a_single_file_and_of_spaces(spark, tmp_path):
    rows = ODD[:6]
    write(spark, rows, tmp_path / "all of it")
    assert sorted(map(repr, map(tuple, exact.digest(spark, str(tmp_path / "all of it")).collect()))) == brute_exact(rows)
    one = next((tmp_path / "all of it").glob("part-*.parquet")).rename(tmp_path / "one file.parquet")
    assert sorted(map(repr, map(tuple, exact.digest(spark, str(one)).collect()))) == brute_exact(rows)


def test_exact_dedup_has_no_python(spark, tmp_path):
    write(spark, ODD, tmp_path / "d")
    plan = exact.digest(spark, str(tmp_path / "d"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "RocksDB" in str(exact._STATE)
