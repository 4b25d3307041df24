"""Substring deduplication with suffix arrays: bytes covered by a string that also starts in an earlier document go.

Strings of ``length`` bytes are dealt out so that equal ones meet: each start belongs to the smallest hash among the
``GRAM``-byte grams of its string (its anchor), and a run of starts with one anchor travels as one segment. First only
the anchors' fingerprints are dealt out, and those that two documents have are told to the documents' groups. Then the
segments of these anchors are packed by anchor into compressed blocks, equal ones of a block once, with the places
where they occur.

Where the blocks of a bucket meet, the suffixes of all distinct segments are put in order by deep-shallow sorting:
multikey refinement, ``SHALLOW`` words of eight bytes deep, then a blind trie for each group that still agrees.
Neighbours that agree for ``length`` bytes are one string; its smallest document keeps it, and its places in other
documents are given back as spans. Whatever goes back to documents is packed by groups of documents, which hold
1 / spark.sql.shuffle.partitions of them; texts are shuffled once.

Every segment holds at most 2 * length bytes. A string that a third of all documents share costs its bucket one segment
per block and some 40 bytes per place, not its text again.

Defined results: a null text is empty; a null key removes nothing and loses nothing; rows of one key are one
document to each other, whether their texts agree or not; texts shorter than ``length`` stay whole; an empty table gives
an empty result; other columns are ignored by ``digest`` and kept by ``deduplicate`` (its own replaces a clashing one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.text import chunks, groups_for, in_arrow, mix

LENGTH = 50
GRAM = 16
SHALLOW = 3
#: Buckets for each shuffle partition, so that tasks get much the same.
BUCKETS = 2
_CHUNK = 1 << 21

_ODD = np.random.Generator(np.random.PCG64(50)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a big-endian number."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - 7,), dtype=">u8", buffer=np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def _hash(w: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """A hash of the ``size`` >= 8 bytes at each position."""
    steps = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    total = None
    for i, s in enumerate(steps):
        part = (w[slice(at.start + s, at.stop + s)] if isinstance(at, slice) else w[at + s]) * _ODD[i]
        total = part if total is None else total + part
    return mix(total)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    m, have = h, 1
    while 2 * have <= width:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if width > have else m


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after another."""
    at = np.cumsum(size) - size
    return data[np.repeat(start - at, size) + np.arange(int(size.sum()))]


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: (text number, start, bytes, anchor's position, anchor's hash, hash of the bytes)."""
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    if len(data) < length:
        return empty
    w = _words(data)
    grams = _hash(w, slice(0, len(data) - GRAM + 1), GRAM)
    place = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(place, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = owner[: len(anchor)] == owner[length - 1 :]
    p = np.flatnonzero(valid)
    if not len(p):
        return empty
    new = np.ones(len(p), dtype=bool)
    new[1:] = (anchor[p][1:] != anchor[p][:-1]) | (owner[p][1:] != owner[p][:-1])
    at = np.flatnonzero(new)
    first, last = p[at], p[np.append(at[1:], len(p)) - 1]
    content = mix(_hash(w, first, length) * _ODD[40] + _hash(w, last, length) * _ODD[41] + (last - first).astype(np.uint64))
    return owner[first], first, last - first + length, anchor[first], grams[anchor[first]], content


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block: their lengths, then their bytes."""
    head = np.array([a.nbytes for a in arrays], "<i8")
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def _unpack(blocks: list[bytes], kinds: tuple[str, ...], steps: int) -> list[np.ndarray]:
    """The arrays of all blocks, joined; array number ``steps`` holds differences of keys."""
    got: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for block in blocks:
        raw = zstandard.ZstdDecompressor().decompress(block)
        at = 8 * len(kinds)
        for i, size in enumerate(np.frombuffer(raw, "<i8", len(kinds)).tolist()):
            x = np.frombuffer(raw, kinds[i], size // np.dtype(kinds[i]).itemsize, at)
            got[i].append(np.cumsum(x) if i == steps else x)
            at += size
    return [np.concatenate(x) for x in got]


def _table(number: list[int] | np.ndarray, blocks: list[bytes], name: str) -> pa.Table:
    return pa.table({name: pa.array(number, pa.int32()), "block": pa.array(blocks, pa.binary())})


def _dealt(part: np.ndarray, order: np.ndarray, pack) -> tuple[list[int], list[bytes]]:
    """One block for each part number, of its rows in ``order`` (which sorts by part)."""
    sorted_ = part[order]
    edge = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(order) else np.zeros(0, np.int64)
    stop = np.append(edge[1:], len(order))[: len(edge)]
    return sorted_[edge].tolist(), [pack(order[a:b]) for a, b in zip(edge, stop, strict=True)]


def _steps(key: np.ndarray) -> np.ndarray:
    return np.diff(key, prepend=0).astype("<i8")


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a key belongs to; the same as the column that ``_rows`` makes."""
    return (key ^ (key >> 16)) % groups


_ANCHOR = ("<u4", "<i8", "<u2", "<u4")
_PLACE = ("<i8", "<u2", "<u4")
_SPAN = ("<i8", "<u2", "<u4", "<u4")
_SEGMENT = ("<u2", "<u2", "<i4", "<i8", "<u2", "<u4", "u1")


def _anchors(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """(b, block) of rows (k, tag, t): fingerprints of anchors with key, tag and start of their segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, data, offsets in chunks(batch.column(2), _CHUNK):
                text, start, _, _, gram, _ = segments(data, offsets, length)
                bucket = ((gram & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
                key, tag, begin, print_ = keys[a + text], tags[a + text].astype("<u2"), (start - offsets[text]).astype("<u4"), (gram >> np.uint64(32)).astype("<u4")
                number, blocks = _dealt(bucket, np.argsort(bucket, kind="stable"), lambda x: _pack(print_[x], _steps(key[x]), tag[x], begin[x]))  # noqa: B023
                yield _table(number, blocks, "b").combine_chunks().to_batches()[0] if number else pa.RecordBatch.from_pydict({"b": pa.array([], pa.int32()), "block": pa.array([], pa.binary())})

    return in_arrow(rows, run, "b int, block binary")


def _shared(blocks: list[bytes], groups: int) -> pa.Table:
    """(g, block): the places of a bucket's anchors that two documents have, packed by group of documents."""
    print_, key, tag, start = _unpack(blocks, _ANCHOR, 1)
    order = np.argsort(print_, kind="stable")
    at = np.flatnonzero(np.append(True, print_[order][1:] != print_[order][:-1]))
    shared = np.minimum.reduceat(key[order], at) != np.maximum.reduceat(key[order], at)
    kept = order[np.repeat(shared, np.diff(np.append(at, len(order))))]
    key, tag, start = key[kept], tag[kept], start[kept]
    g = group_of(key, groups)
    return _table(*_dealt(g, np.lexsort((start, tag, key, g)), lambda x: _pack(_steps(key[x]), tag[x], start[x])), "g")


def _cut(docs: pa.Table, blocks: list[bytes], length: int, buckets: int) -> pa.Table:
    """(b, block): the segments of a group of documents (k, tag, t) at the given places, packed by anchor."""
    key, tag, start = _unpack(blocks, _PLACE, 0)
    if not len(key):
        return _table([], [], "b")
    rows: dict[tuple[int, int], int] = {}
    for i, pair in enumerate(zip(docs.column("k").to_pylist(), docs.column("tag").to_pylist(), strict=True)):
        rows.setdefault(pair, i)  # rows of one key and tag have one text
    change = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])))
    row = [rows[int(key[i]), int(tag[i])] for i in change]
    wanted = np.unique((np.repeat(row, np.diff(np.append(change, len(key)))).astype(np.int64) << 32) | start)
    keys, tags = docs.column("k").to_numpy(), docs.column("tag").to_numpy()
    numbers: list[int] = []
    out: list[bytes] = []
    for a, _, data, offsets in chunks(docs.column("t"), 2 * _CHUNK):
        text, start, size, anchor, gram, content = segments(data, offsets, length)
        code = ((a + text) << 32) | (start - offsets[text])
        hit = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
        text, start, size, anchor, gram, content = (x[hit] for x in (text, start, size, anchor, gram, content))
        bucket = ((gram & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        own, own_tag, begin = keys[a + text], tags[a + text].astype("<u2"), (start - offsets[text]).astype("<u4")

        def pack(x: np.ndarray) -> bytes:
            same = (gram[x][1:] == gram[x][:-1]) & (content[x][1:] == content[x][:-1])  # noqa: B023
            at = np.flatnonzero(np.append(True, ~same))
            one = x[at]
            times = np.diff(np.append(at, len(x))).astype("<i4")
            return _pack(size[one].astype("<u2"), (anchor[one] - start[one]).astype("<u2"), times, _steps(own[x]), own_tag[x], begin[x], _gather(data, start[one], size[one]))  # noqa: B023

        # equal segments together, their places by text and start
        n, b = _dealt(bucket, np.lexsort((start, content, gram, bucket)), pack)
        numbers += n
        out += b
    return _table(numbers, out, "b")


def shallow_groups(words: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` words, and each one's group of equals.

    Multikey refinement: only suffixes that still agree with another are ordered by their next word.
    """
    order = np.arange(len(start))
    group = np.zeros(len(start), np.int64)  # by rank in ``order``
    active = np.arange(len(start))
    for d in range(depth):
        if not len(active):
            break
        key = words[start[order[active]] + 8 * d]
        by = np.lexsort((key, group[active]))
        order[active] = order[active][by]
        key = key[by]
        old = group[active]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        alone = new & np.append(new[1:], True)
        active = active[~alone]
    return order, group


def blind_trie(strings: list[bytes], depth: int) -> list[list[int]]:
    """Classes of equal strings, in order. All strings have one length and agree on their first ``depth`` bytes.

    Nodes keep only the position where their strings part. A string goes down by those bytes alone, is compared with
    the leaf that it reaches, and is put in where it first parts from it.
    """
    length = len(strings[0])
    leaves: list[list[int]] = [[0]]
    root: object = 0  # a leaf's number, or [position, {byte: node}]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, list):
            children = node[1]
            node = children.get(s[node[0]])
            if node is None:
                node = next(iter(children.values()))
        t = strings[leaves[node][0]]
        if s == t:
            leaves[node].append(i)
            continue
        part = depth
        while s[part] == t[part]:
            part += 1
        leaves.append([i])
        parent, byte, node = None, 0, root
        while isinstance(node, list) and node[0] < part:
            parent, byte = node, s[node[0]]
            node = node[1][byte]
        if isinstance(node, list) and node[0] == part:
            node[1][s[part]] = len(leaves) - 1
            continue
        fresh = [part, {t[part]: node, s[part]: len(leaves) - 1}]
        if parent is None:
            root = fresh
        else:
            parent[1][byte] = fresh
    out: list[list[int]] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out.append(leaves[node])
    assert length >= depth
    return out


def suffix_classes(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the number of its class: suffixes of a class agree for ``length`` bytes. Numbers are in order."""
    words = _words(np.append(data, np.zeros(8, np.uint8)))
    depth = min(SHALLOW, length // 8)
    order, group = shallow_groups(words, start, depth)
    new = np.ones(len(order), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(order))) > 1
    text = data.tobytes()
    rank = np.arange(len(order))  # a class's number is the place of its first suffix
    if depth * 8 < length:
        for a, b in zip(first[many].tolist(), np.append(first[1:], len(order))[many].tolist(), strict=True):
            own = order[a:b].copy()
            at = a
            for same in blind_trie([text[s : s + length] for s in start[own].tolist()], 8 * depth):
                order[at : at + len(same)] = own[same]
                rank[at : at + len(same)] = at
                at += len(same)
    else:
        rank = first[np.cumsum(new) - 1]
    out = np.empty(len(order), np.int64)
    out[order] = rank
    return out


def removed(blocks: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, tag, start, end) of the spans that the documents of a bucket lose."""
    size, anchor, times, key, tag, start, body = _unpack(blocks, _SEGMENT, 3)
    size, start = size.astype(np.int64), start.astype(np.int64)
    segment = np.repeat(np.arange(len(times)), times)
    offset = np.cumsum(size) - size
    low = np.minimum.reduceat(key, np.append(0, np.cumsum(times))[:-1])
    # distinct segments and the smallest document of each
    text = body.tobytes()
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(text[a : a + n], len(number)) for a, n in zip(offset.tolist(), size.tolist(), strict=True)])
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, low)
    size = np.fromiter(map(len, number), np.int64, len(number))
    data = np.frombuffer(b"".join(number), np.uint8)
    begin = np.cumsum(size) - size
    # all suffixes of ``length`` bytes or more, in order
    starts = size - length + 1
    suffix = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    cls = suffix_classes(data, suffix, length)
    own = np.repeat(least, starts)
    keeper = np.full(len(cls), np.iinfo(np.int64).max)
    np.minimum.at(keeper, cls, own)
    keeper = keeper[cls]
    # a document after the smallest one that has a segment loses all of it; only the smallest one's places, few for each
    # segment however many documents share it, are looked at string by string
    seg = of[segment]
    after = key > least[seg]
    some = np.flatnonzero(~after)
    n = starts[seg[some]]
    base = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(base, n)
    gone = keeper[np.repeat((np.cumsum(starts) - starts)[seg[some]], n) + step] < np.repeat(key[some], n)
    rise = gone.copy()
    rise[1:] &= ~(gone[:-1] & (step[1:] > 0))
    fall = gone.copy()
    fall[:-1] &= ~(gone[1:] & (step[1:] > 0))
    a, b = np.flatnonzero(rise), np.flatnonzero(fall)
    who = some[np.repeat(np.arange(len(some)), n)[a]]
    whole = np.flatnonzero(after)
    place = np.concatenate([whole, who])
    begin = np.concatenate([start[whole], start[who] + step[a]])
    end = np.concatenate([start[whole] + size[seg[whole]], start[who] + step[b] + length])
    return key[place], tag[place], begin, end


def _lost(blocks: list[bytes], length: int, groups: int) -> pa.Table:
    """(g, block): the spans of ``removed``, packed by group of documents."""
    key, tag, start, end = removed(blocks, length)
    g = group_of(key, groups)
    return _table(*_dealt(g, np.lexsort((start, tag, key, g)), lambda x: _pack(_steps(key[x]), tag[x], start[x].astype("<u4"), end[x].astype("<u4"))), "g")


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of (start, end) rows."""
    s = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    end = np.maximum.accumulate(s[:, 1])
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:, 0] > end[:-1]
    at = np.flatnonzero(new)
    return np.stack([s[at, 0], end[np.append(at[1:], len(s)) - 1]], 1)


def _rows(docs: DataFrame, key: str, text: str, groups: int) -> DataFrame:
    """``docs`` with k, tag, t and g, the group of documents."""
    k = F.col(f"`{key}`").cast("long")
    again = not docs.filter(k.isNotNull()).groupBy(k).agg(F.count("*").alias("m")).filter("m > 1").isEmpty()
    # rows of one key are told apart by 16 bits of their text's hash, where there are such rows
    tag = F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(1 << 16)).cast("int") if again else F.lit(0)
    g = F.pmod(F.coalesce(k.bitwiseXOR(F.shiftright(k, 16)), F.xxhash64(F.col(f"`{text}`"))), F.lit(groups)).cast("int")
    return docs.select(k.alias("k"), tag.alias("tag"), F.col(f"`{text}`").alias("t"), g.alias("g"), *[F.col(f"`{c}`") for c in docs.columns if c not in (key, text)])


def with_spans(docs: DataFrame, finish, schema: str | T.StructType, *, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``finish(rows, spans)`` over groups of documents.

    ``rows`` is an Arrow table of the group's rows (k the key, t the text, and the other columns of ``docs``), ``spans``
    a list with each row's (start, end) spans to remove, or None.
    """
    if length < GRAM:
        raise ValueError(f"strings have {GRAM} bytes at least")
    groups = groups_for(docs, text)
    buckets = BUCKETS * groups
    rows = _rows(docs, key, text, groups)
    blocks = lambda t: t.column("block").to_pylist()
    anchors = _anchors(rows.filter("k IS NOT NULL").select("k", "tag", "t"), length, buckets)
    places = anchors.groupBy("b").applyInArrow(lambda t: _shared(blocks(t), groups), "g int, block binary")
    parts = rows.groupBy("g").cogroup(places.groupBy("g")).applyInArrow(lambda d, t: _cut(d, blocks(t), length, buckets), "b int, block binary")
    lost = parts.groupBy("b").applyInArrow(lambda t: _lost(blocks(t), length, groups), "g int, block binary")

    def end(docs: pa.Table, found: pa.Table) -> pa.Table:
        key, tag, start, stop = _unpack(blocks(found), _SPAN, 0)
        order = np.lexsort((tag, key))
        key, tag, pairs = key[order], tag[order], np.stack([start, stop], 1).astype(np.int64)[order]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1]))) if len(key) else np.zeros(0, np.int64)
        own = {(int(key[i]), int(tag[i])): x for i, x in zip(at, np.split(pairs, at[1:]), strict=bool(len(at)))} if len(at) else {}
        return finish(docs, [own.get(x) for x in zip(docs.column("k").to_pylist(), docs.column("tag").to_pylist(), strict=True)])

    return rows.groupBy("g").cogroup(lost.groupBy("g")).applyInArrow(end, schema)


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with a binary column kept_bytes: each text's bytes without the removed ones."""
    docs = docs.drop("kept_bytes")
    clash = {c: f"_own_{c}" for c in ("k", "tag", "t", "g") if c in docs.columns and c not in (key, text)}
    source = {key: "k", text: "t"}
    schema = T.StructType([*docs.schema, T.StructField("kept_bytes", T.BinaryType())])

    def finish(rows: pa.Table, spans: list) -> pa.Table:
        kept = pa.array([_kept(t, s)[0] for t, s in zip(rows.column("t").to_pylist(), spans, strict=True)], pa.binary())
        return pa.table([*(rows.column(source.get(c) or clash.get(c, c)) for c in schema.names[:-1]), kept], schema.names)

    renamed = docs.withColumnsRenamed(clash)
    wide = T.StructType([T.StructField(f.name, T.LongType() if f.name == key else f.dataType) for f in schema])
    out = with_spans(renamed, finish, wide, key=key, text=text, length=length)
    return out.withColumn(key, F.col(f"`{key}`").cast(docs.schema[key].dataType))


def _kept(text: str | None, spans: np.ndarray | None) -> tuple[bytes, int, int]:
    """What stays, bytes removed, runs removed."""
    data = (text or "").encode()
    if spans is None:
        return data, 0, 0
    runs = _merged(spans).tolist()
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]), sum(b - a for a, b in runs), len(runs)


def digest(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def finish(rows: pa.Table, spans: list) -> pa.Table:
        out = []
        for t, s in zip(rows.column("t").to_pylist(), spans, strict=True):
            data, gone, runs = _kept(t, s)
            out.append((len(data) + gone, gone, runs, hashlib.sha256(data).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([rows.column("k"), *(pa.array(columns[i], pa.int64()) for i in range(3)), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = with_spans(docs.select("doc_id", "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length=length)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, runs, SHA-256 of the rest) of each row by a plain table of strings, for tests."""
    least: dict[bytes, int] = {}
    texts = [(k, (t or "").encode()) for k, t in rows]
    for k, t in texts:
        for i in range(len(t) - length + 1) if k is not None else ():
            s = t[i : i + length]
            least[s] = min(least.get(s, k), k)
    out = []
    for k, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1) if k is not None else ():
            if least[t[i : i + length]] < k:
                gone[i : i + length] = True
        stay = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(t), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(t) else 0, hashlib.sha256(stay).hexdigest()))
    return out
