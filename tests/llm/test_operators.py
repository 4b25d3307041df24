import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, neardup, packing, passages, pii, quality, queries, suffixes, tokens, toxicity, warc

FOLDER = "/root/testdata/sf0.001"


def words(seed, n, size=400):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.randrange(size)}" for _ in range(n)]


def docs(spark, rows):
    """doc_id, text, and columns whose names clash with ones that operators make."""
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, spans string, k int")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    base = " ".join(words(1, 300))
    rows = [(1, base), (2, base), (2, base), (3, ""), (4, None), (None, base), (5, " \n\t "), (6, "one"), (7, " ".join(words(2, 4000))), (8, base + " more words here"), (9, "é ü ß 漢字 \U0001f600")]
    return docs(spark, rows)


# ---- 1


def test_decontamination(spark, odd):
    b = words(1, 300)
    items = [(1, " ".join(b[10:40])), (2, "É ü ß"), (3, None), (4, "..."), (None, " ".join(b[200:220])), (5, " ".join(b[10:40])), (11, "one")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(odd, df).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = decontaminate.brute_force([t for _, t in rows], items)
    make = lambda k, w: (k, w[0], w[1], len([i for i in w[2] if i != "None"]), hashlib.sha256(",".join(i for i in w[2] if i != "None").encode()).hexdigest(), w[1] > 0 and 20 * w[1] >= w[0])
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(make(k, w)) for (k, _), w in zip(rows, want, strict=True))
    joined = decontaminate.annotate(odd.select("doc_id", "text"), df, max_windows=3)
    direct = decontaminate.annotate(odd.select("doc_id", "text"), df)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, direct.collect()))
    kept = decontaminate.decontaminate(odd, df)
    assert kept.columns == odd.columns and {r.spans for r in kept.collect()} == {"x"} and 1 not in {r.doc_id for r in kept.collect()}
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(odd.filter("doc_id = 1"), df).collect()}
    assert b[15] not in cut[1].split() and b[100] in cut[1].split()


# ---- 2


def brute_near(rows, percent=85):
    sets, parent = {}, {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        if k is not None:
            sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            parent[k] = k

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in ids}


def test_near_duplicates(spark, odd):
    r = random.Random(5)
    rows = [(x.doc_id, x.text) for x in odd.collect()]
    base = words(3, 120)
    for i in range(100, 190):  # a family whose members differ more and more, and share edits
        w = list(base)
        for _ in range(r.randrange(9)):
            p = r.randrange(len(w))
            w[p : p + 1] = [] if r.random() < 0.5 else ["edit"]
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    want = brute_near(rows)
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is not None:
            assert (x.n_shingles, x.component_id, x.kept) == (*want[x.doc_id], want[x.doc_id][1] == x.doc_id), x


def test_registers_estimate_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:850], r.integers(0, 2**63, 150, dtype=np.uint64)])
    ra, rb = neardup.registers(a), neardup.registers(b)
    assert (np.maximum(ra, rb) == neardup.registers(np.concatenate([a, b]))).all()
    e = neardup.likelihood_estimate(ra[None].astype(int), rb[None].astype(int), np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(e - 850 / 1150) < 0.15


# ---- 3


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(odd, path, capacity=256).collect()
    want = Counter()
    for r in odd.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[a : a + 256], "<u4")
            want[r.doc_id, p, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) + 1


@pytest.mark.parametrize("seed", range(3))
def test_plan_holds_the_histogram(seed):
    r = np.random.default_rng(seed)
    count = np.bincount(r.integers(1, 129, 3000), minlength=129)
    plan = packing.solve(count, 128, 100)
    held = Counter()
    for p, m in plan:
        assert sum(p) <= 128 and m > 0
        for c in p:
            held[c] += m
    assert [held[c] for c in range(129)] == count.tolist()
    assert sum(m for _, m in plan) <= 1.03 * (count * np.arange(129)).sum() / 128 + 1
    assert packing.solve(np.zeros(129, int), 128) == []


def optimum(pieces, capacity):
    """The fewest sequences, by trying them all: each sequence starts with the largest piece that is left."""
    best = len(pieces)

    def go(left, used):
        nonlocal best
        if used + -(-sum(left) // capacity) >= best:
            return
        if not left:
            best = used
            return

        def fill(rest, room, i):
            full = True
            for j in range(i, len(rest)):
                if rest[j] <= room and (j == i or rest[j] != rest[j - 1]):
                    full = False
                    fill(rest[:j] + rest[j + 1 :], room - rest[j], j)
            if full or i:
                go(rest, used + 1)

        fill(left[1:], capacity - left[0], 0)

    go(sorted(pieces, reverse=True), 0)
    return best


def test_plans_against_an_exact_optimum():
    r, more = random.Random(4), 0
    for _ in range(40):
        pieces = [r.randrange(1, 20) for _ in range(r.randrange(1, 11))]
        got = packing.solution(np.bincount(pieces, minlength=21), 20)
        want = optimum(pieces, 20)
        assert got.bound <= want <= sum(m for _, m in got.plan)
        more += sum(m for _, m in got.plan) - want
    assert more <= 2


@pytest.mark.parametrize("times", [1, 40])
def test_most_sequences_come_from_the_program(times):
    r = np.random.default_rng(7)
    count = np.bincount(np.minimum(512, 1 + r.lognormal(4.5, 1.1, 4000).astype(int)), minlength=513) * times
    count[512] = 0
    got = packing.solution(count, 512)
    made = sum(m for _, m in got.plan)
    assert got.from_program >= 0.9 * made and got.bound <= made <= 1.002 * got.bound + 3
    assert made <= sum(m for _, m in packing.best_fit(count, 512)) + 2


def test_pre_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    t, own = Tokenizer.from_file(path), packing._Ids(path)
    for s in ("It's WE'LL don't", "a\x1cb\xa0c", "<|endoftext|> x<|startoftext|>y", "́x İ ΑΣ", "½²ª µ ß ẞ ﬁ", "漢字\U0001f600 ok", "\x01\x7f¡"):
        assert np.frombuffer(own.of(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


# ---- 4


def test_suffix_dedup(spark, odd):
    r = random.Random(9)
    rows = [(x.doc_id, x.text) for x in odd.collect()]
    rows += [(2, "another text of the same key " * 4), (30, "ab" * 200), (31, "ab" * 100), (-5, "".join(r.choice("ab") for _ in range(500)))]
    shared = "".join(r.choice("abcd ") for _ in range(120))
    rows += [(40 + i, "".join(r.choice("xyz") for _ in range(60)) + shared[r.randrange(50) :] + "é" * r.randrange(40)) for i in range(12)]
    got = sorted(map(repr, map(tuple, suffixes.digest(docs(spark, rows)).collect())))
    assert got == sorted(repr((k, *w)) for (k, _), w in zip(rows, suffixes.brute_force(rows), strict=True))
    kept = suffixes.deduplicate(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "spans", "k", "kept_bytes"]
    assert Counter(hashlib.sha256(x.kept_bytes).hexdigest() for x in kept.collect()) == Counter(w[3] for w in suffixes.brute_force(rows))


def test_suffixes_are_in_order():
    r = random.Random(2)
    data = "".join(r.choice("ab") for _ in range(2000)).encode()
    start = np.arange(len(data) - 30)
    cls = suffixes.suffix_classes(np.frombuffer(data, np.uint8), start, 30)
    order = np.argsort(cls, kind="stable")
    strings = [data[s : s + 30] for s in order]
    assert strings == sorted(strings)
    assert len(set(cls.tolist())) == len(set(strings))


# ---- 5


def test_base_patterns_equal_plain_ones():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice("a@.b-_1 2+") for _ in range(r.randrange(30)))
        got = pii.base_spans(t)
        assert [x[1:] for x in got if x[0] == "email"] == [m.span() for m in email.finditer(t)]
        assert [x[1:] for x in got if x[0] == "ip"] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write bob at example dot com now", "email", "bob at example dot com"),
        ("bob (at) mail [dot] example [dot] org x", "email", "bob (at) mail [dot] example [dot] org"),
        ("b​ob＠mail．com", "email", "b​ob＠mail．com"),
        ("bоb@mail.com", "email", "bоb@mail.com"),
        ("+１ 555 555‑１234 ok", "phone", "+１ 555 555‑１234"),
        ("plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("at 10 dot 0 dot 0 dot 1 yes", "ip", "10 dot 0 dot 0 dot 1"),
    ],
)
def test_disguises_map_back(text, kind, found):
    base, added = pii.all_spans(text)
    assert (kind, found) in [(k, text[a:b]) for k, a, b in added]
    assert base == pii.base_spans(text)


def test_plain_prose_gives_nothing():
    for t in ("Look at the dot. It was at one time two or three.", "meet at noon", "1.2.3", "4111 1111 1111 1112", "a@b", ""):
        assert pii.all_spans(t) == ([], [])


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("call plus 44 20 7946 0958 now", "phone"),
        ("+1 oh oh 5 5 5 1 2 3 4 oh", "phone"),
        ("+\u09e7 \u09e8\u09e9\u09ea \u09eb\u09ec\u09ed \u09ee\u09ef\u09e6\u09e6", "phone"),
        ("card \u0e54\u0e51\u0e51\u0e51 1111 1111 1111", "card"),
        ("\U0001d7dc111 1111 1111 1111", "card"),
    ],
)
def test_disguises_need_no_other_cue(text, kind):
    assert kind in [k for k, _, _ in pii.all_spans(text)[1]]


def test_quick_look_passes_all_that_changes():
    r = random.Random(5)
    bits = "one two Oh ZERO nine double triple plus dot DOT at (at) [ dot ] <AT> { at} a@b 5 44 x fi\u0131ve f\u0131ve \u017fix \u09e7 \u0e54 \U0001d7dc \u0664 \uff11 \u00ad \u200b \u2011 \u2024 \u2212 \u0430 \u03bf \u00e9 \u0130 com é_ plus7".split()
    changed = 0
    for _ in range(20000):
        t = "".join(r.choice(bits) + r.choice(["", " ", " ", " ", "-", ", ", "\n", "."]) for _ in range(r.randrange(1, 7)))
        if pii.normalised(t).text != t:
            changed += 1
            assert pii._cue(t), t
    assert changed > 5000


def test_pii_rows(spark, odd):
    rows = odd.union(docs(spark, [(50, "mail a.b@c.de or 4111 1111 1111 1111, +1 (555) 555-0123 at 10.0.0.1")]))
    got = {r.doc_id: r for r in pii.digest(rows).collect()}
    r = got[50]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() and r.spans.startswith("email:5:13,ip:")
    assert got[4].base_sha256 == pii.EMPTY_SHA256 and got[4].spans == ""
    assert [x.text for x in pii.mask(rows).filter("doc_id = 50").collect()] == ["mail <EMAIL> or <CARD>, <PHONE> at <IP>"]
    assert pii.mask(rows).columns == rows.columns


# ---- 6


def test_quality_rules(spark, odd):
    line = "this is the same line of words again and again"
    rows = odd.union(docs(spark, [(60, "\n".join([line] * 9)), (61, "# $ " * 20), (62, "a b c d e f g h " * 2 + " ".join(words(4, 30)))]))
    m = {r.doc_id: r for r in quality.digest(rows).collect()}
    assert (m[4].n_words, m[4].base_failed, m[3].kept) == (0, True, False)
    assert m[60].n_dup_lines == 8 and m[60].n_repeat_words == m[60].n_words and m[60].base_failed
    assert m[61].n_symbols == 40 and m[62].n_repeat_words == 16
    for r in rows.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        g = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + j for i in range(len(w) - 7) if g[tuple(w[i : i + 8])] > 1 for j in range(8)}
        if r.doc_id is not None:
            assert (m[r.doc_id].n_words, m[r.doc_id].word_chars, m[r.doc_id].n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
    plan = quality.digest(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 7


def test_warc_round_trip(spark):
    html = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 30
    rows = [(1, "http://a", html), (2, "http://b", html), (3, "http://c", None), (4, None, ""), (5, "http://d\r\nX: y", "z" * 5000), (None, "u", html), (6, "e", "漢" * 3000)]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, size int")
    got = {r.page_id: r for r in warc.round_trip(pages, segment=700).collect()}
    assert len(got) == 7
    for k, _, h in rows:
        assert (got[k].payload_bytes, got[k].payload_digest) == (len((h or "").encode()), warc.digest((h or "").encode()))
    assert [(got[k].record_type, got[k].refers_to) for k in (1, 2, 3, 4, None)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None)]


def test_segments_are_verified(spark):
    r = [(None, "response", None, "", 0, "o", 1, None, b"ab"), (None, "continuation", None, "", 0, "o", 3, 4, b"cd")]
    with pytest.raises(Exception, match="segments missing"):
        warc.reassembled(spark.createDataFrame(r, warc._RECORD)).collect()
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")
    assert warc.unchunked(b"2;x=y\r\nab\r\n1\r\nc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"


# ---- 8


def test_passages(spark, odd):
    shared = words(20, 60)
    rows = [(i, " ".join(words(200 + i, 90) + (shared if i % 3 == 0 else []) + words(300 + i, 40))) for i in range(12)]
    rows += [(50, " ".join(shared[:30] + ["changed"] + shared[31:])), (51, None), (52, ""), (None, " ".join(shared)), (9, rows[9][1])]
    got = passages.near_duplicate_passages(docs(spark, rows)).collect()
    found = {r.doc_id for r in got}
    assert found == {3, 6, 9, 50} and all(r.source_id < r.doc_id for r in got)
    for r in got:
        if r.doc_id != 50:
            assert (r.start, r.stop, r.similarity) == (90, 150, 1.0)


def test_passages_at_the_contract_similarity_are_found(spark):
    rows = []
    for i in range(150):
        w = [f"p{i}x{j}" for j in range(56)]
        other = list(w)
        other[28] = f"y{i}"  # 47 of 52 shingles shared, 47 / 57 = 0.82; neither half is long enough alone
        rows += [(2 * i, " ".join(words(5000 + i, 30) + w)), (2 * i + 1, " ".join(words(9000 + i, 20) + other))]
    got = {r.doc_id: (r.source_id, r.start) for r in passages.near_duplicate_passages(docs(spark, rows)).collect()}
    assert got == {2 * i + 1: (2 * i, 20) for i in range(150)}


def test_passages_do_not_depend_on_which_side_is_longer():
    w = [f"w{i}" for i in range(84)]
    longer = w[:42] + [f"x{i}" for i in range(10)] + w[42:]
    for a, b in ((w, longer), (longer, w)):
        span = {"low": 0, "high": len(b) - 5, "at": [0, len(b) - 5], "shift": [0, len(a) - len(b)]}
        got = passages._verified(*passages._shingled([" ".join(x).encode() for x in (b, a)]), [span], 46, 80)
        assert [(x, y, u, v) for x, y, u, v, _ in got] == [(0, len(b) - 4, 0, len(a) - 4)] and got[0][4] == 76 / 94


def test_verification_finds_what_brute_force_finds():
    r, width, some = random.Random(8), 8, 0
    for n in range(300):
        own = r.sample(range(1000), 22)
        other = list(own)
        for side in (own, other):
            for _ in range(r.randrange(6)):
                at = r.randrange(len(side))
                side[at : at + r.choice([0, 1, 2])] = [1000 + r.randrange(10**6) for _ in range(r.choice([0, 1, 2, 4]))]
        want = False
        for x in range(len(own)):
            for y in range(x + width, len(own) + 1):
                if own[x] in other and own[y - 1] in other:
                    a, b = set(own[x:y]), set(other[other.index(own[x]) : other.index(own[y - 1]) + 1])
                    want |= 100 * len(a & b) >= 80 * len(a | b)
        span = {"low": 0, "high": len(own) - 1, "at": [0], "shift": [0]}
        got = passages._verified(np.array(own, np.uint64), np.array(other, np.uint64), [span], width, 80)
        assert bool(got) == want, n
        assert all(j >= 0.8 for *_, j in got)
        some += want
    assert 30 < some < 290


def test_compact_windows_cover_every_long_range():
    h = np.random.default_rng(3).integers(0, 50, 60).astype(np.uint64)
    w = passages.compact_windows(h, 10)
    for i in range(60):
        for j in range(i + 10, 61):
            c = i + int(h[i:j].argmin())
            assert sum(a <= i and j - 1 <= b and m == c for a, m, b in w) == 1


# ---- 9


def test_toxicity(spark):
    bad = ["grumblefitz", "snorkwad"]
    rows = [(i, " ".join(words(i, 60) + ([bad[i % 2]] if i % 4 == 0 else []))) for i in range(600)] + [(1000, None), (1001, ""), (None, "x")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(1000, None), (5000, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, rows), labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_do_not_count(spark):
    rows = docs(spark, [(i, " ".join(words(i, 30) + ["vile"] * (i % 3 == 0))) for i in range(120)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(rows, y).collect()} for y in (labels, turned))
    assert a == b


def test_one_class_only(spark):
    rows = docs(spark, [(1, "a"), (2, "b")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(rows, none).collect()} == {0}


# ---- 10


def test_token_counts(spark, odd):
    import public_tokenizers

    ranks, pattern = queries.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoder, size = tokens._encoder(ranks, pattern)
    text = "line one\n\n\n  line two\r\nünï \U0001f600\n"
    rows = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(docs(spark, [(70, text)]))
    for rule in ("first", "last", "most"):
        got = tokens.by_section(rows, ranks, pattern, rule=rule).collect()
        for r in rows.collect():
            own = sorted((g for g in got if g.doc_id == r.doc_id), key=lambda g: g.section)
            data = (r.text or "").encode()
            assert [data[g.start : g.stop] for g in own] == data.splitlines(keepends=True) if b"\r" not in data else True
            want, at = Counter(), 0
            for i in encoder.encode_ordinary(r.text or ""):
                spots = [next(g.section for g in own if g.start <= p < g.stop) for p in range(at, at + size[i])]
                pick = spots[0] if rule == "first" else spots[-1] if rule == "last" else max(sorted(set(spots)), key=spots.count)
                want[pick] += 1
                at += int(size[i])
            assert {g.section: g.n_tokens for g in own if g.n_tokens} == dict(want)
    fields = {r.spans: (r.n_docs, r.n_tokens) for r in tokens.by_field(rows, ranks, pattern, ["spans"]).collect()}
    assert fields["x"][1] == sum(len(encoder.encode_ordinary(r.text or "")) for r in rows.collect())


# ---- empty tables


def test_empty_tables(spark):
    import public_tokenizers

    none = docs(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        decontaminate.digest(none, items), neardup.near_duplicates(none), packing.pack_documents(none, queries.vocabulary()), suffixes.digest(none), pii.digest(none), quality.digest(none), warc.round_trip(pages),
        passages.near_duplicate_passages(none), toxicity.toxicity(none, labels), tokens.by_section(none, queries.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    ):
        assert df.count() == 0


def test_cards_and_phones_equal_plain_patterns():
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    r, some = random.Random(6), Counter()
    for _ in range(9000):
        t = "".join(r.choice("0123456789 -+()x.4111") for _ in range(r.randrange(60)))
        got = pii.base_spans(t)
        cards = []
        for m in card.finditer(t):
            d = [int(c) for c in m.group() if c.isdigit()]
            total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
            if 13 <= len(d) <= 19 and total % 10 == 0:
                cards.append(m.span())
        phones = [m.span() for m in phone.finditer(t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        assert [x[1:] for x in got if x[0] == "card"] == cards and [x[1:] for x in got if x[0] == "phone"] == phones
        some["card"] += len(cards)
        some["phone"] += len(phones)
    assert min(some.values()) > 50


def test_pii_digest_is_of_the_plain_patterns(spark):
    texts = ["a.b@c.de x@y 1.2.3.4 999.1.1.1 +1 555 555 0123 4111 1111 1111 1111", "", None, "\U0001f600 é@x.y z@x.y"]
    got = {r.doc_id: r for r in pii.digest(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base = pii.base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]


def test_longest_texts(spark):
    """Texts beyond one chunk: results agree with those of their parts or of plain counts."""
    long = " ".join(words(77, 260_000, 10**6))
    assert len(long) > 1_200_000
    rows = docs(spark, [(1, long), (2, long), (3, "short text here")])
    assert {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(rows).collect()} == {1: (1, True), 2: (1, False), 3: (3, True)}
    gone = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.digest(rows).collect()}
    assert gone == {1: (0, 0), 2: (len(long), 1), 3: (0, 0)}
    got = passages.near_duplicate_passages(rows).collect()
    assert [(r.doc_id, r.source_id, r.start, r.stop) for r in got] == [(2, 1, 0, 260_000)]
    item = spark.createDataFrame([(1, " ".join(long.split()[250_000:250_020]))], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.digest(rows, item).collect()} == {1: (260_000, 20), 2: (260_000, 20), 3: (3, 0)}


def test_n_grams_do_not_depend_on_runs(monkeypatch):
    s = toxicity.Settings()
    data = np.frombuffer("Äbcd efgh ijkl ".encode() * 200, np.uint8)
    offsets = np.array([0, 7, 7, len(data)])
    grams = lambda: sorted({(int(o), int(g)) for a, b in toxicity._grams(data, offsets, s) for o, g in zip(a, b, strict=True)})
    want = grams()
    monkeypatch.setattr(toxicity, "RUN", 50)
    assert grams() == want


def test_repeated_rows_count_once_in_the_fit(spark):
    rows = docs(spark, [(i % 50, " ".join(words(i % 50, 20))) for i in range(150)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert toxicity.sample(rows, labels, "doc_id", "text", "toxic", toxicity.Settings(max_rows=10)).count() == 10
