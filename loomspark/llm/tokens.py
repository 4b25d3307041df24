"""Token counts by section: each document is encoded once, and its tokens are attributed to sections by their spans.

The tokens' byte lengths give each token's span in the text. Sections are spans too (here: lines, each with the line
end that closes it); an interval join of the two sorted lists attributes tokens. A token that crosses a border goes by
``rule``: "first" to the section of its first byte, "last" to that of its last byte, "most" to the section with most of
its bytes, the earliest of equals.

Defined results: null and empty texts have no section and give no row in ``by_section`` and zeros in ``digest``;
repeated rows give their rows again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.text import in_arrow

_LOADED: dict[tuple[str, str], tuple] = {}


def _encoder(path: str, pattern: str) -> tuple:
    """The encoder of a rank file and each id's length in bytes."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _LOADED[path, pattern]


def line_ends(data: np.ndarray) -> np.ndarray:
    """The end of each line: after its line feed, or at the text's end."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) or not len(data) else np.append(ends, len(data))


def attribute(ends: np.ndarray, size: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Each token's section, and whether it crosses a border, from the sections' ends and the tokens' lengths."""
    stop = np.cumsum(size)
    start = stop - size
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    crosses = last > first
    if rule == "first":
        return first, crosses
    if rule == "last":
        return last, crosses
    if rule != "most":
        raise ValueError(f"no such rule: {rule}")
    out = first.copy()
    for i in np.flatnonzero(crosses):
        own = np.arange(first[i], last[i] + 1)
        begin = np.where(own > 0, ends[own - 1], 0)
        out[i] = own[np.argmax(np.minimum(ends[own], stop[i]) - np.maximum(begin, start[i]))]
    return out, crosses


def by_section(docs: DataFrame, ranks: str, pattern: str, *, key: str = "doc_id", text: str = "text", rule: str = "first") -> DataFrame:
    """(key, section from 0, start, stop in bytes, n_tokens, n_crossing) of every line of every text.

    n_crossing counts the section's tokens that reach into another section.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, length = _encoder(ranks, pattern)
        for batch in batches:
            row, section, start, stop, tokens, crossing = [], [], [], [], [], []

            def made() -> pa.RecordBatch:
                columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (section, start, stop, tokens, crossing)]
                keys = batch.column(0).take(pa.array(np.concatenate([np.zeros(0, np.int64), *row])))
                return pa.RecordBatch.from_arrays([keys, pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], [key, "section", "start", "stop", "n_tokens", "n_crossing"])

            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                ends = line_ends(np.frombuffer(t.encode(), np.uint8))
                at, over = attribute(ends, length[np.array(encoder.encode_ordinary(t), np.int64)], rule)
                row.append(np.full(len(ends), i))
                section.append(np.arange(len(ends)))
                start.append(np.append(0, ends[:-1]))
                stop.append(ends)
                tokens.append(np.bincount(at, minlength=len(ends)))
                crossing.append(np.bincount(at[over], minlength=len(ends)))
                if len(row) >= 1000:
                    yield made()
                    row, section, start, stop, tokens, crossing = [], [], [], [], [], []
            yield made()

    kind = docs.schema[key].dataType.simpleString()
    return in_arrow(docs.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, section int, start long, stop long, n_tokens long, n_crossing long")


def by_field(docs: DataFrame, ranks: str, pattern: str, fields: list[str], *, key: str = "doc_id", text: str = "text", rule: str = "first") -> DataFrame:
    """(fields, n_docs, n_tokens): tokens of whole texts summed by columns such as source or language."""
    row = docs.withColumn("_row", F.struct(*fields, F.lit(1).alias("_one")))
    counted = by_section(row, ranks, pattern, key="_row", text=text, rule=rule)
    totals = counted.groupBy(*[F.col(f"_row.{f}").alias(f) for f in fields]).agg(F.sum("n_tokens").alias("n_tokens"))
    rows = docs.groupBy(*fields).agg(F.count("*").alias("n_docs"))
    same = [rows[f].eqNullSafe(totals[f]) for f in fields]
    return rows.join(totals, same, "left").select(*[rows[f] for f in fields], "n_docs", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
