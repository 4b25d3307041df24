"""Random forests of many partitions, hold-out parts and settings, grown together, with leaves as the bound.

Features are cut into at most ``BINS`` bins between values of a bounded sample of each partition. A tree's bootstrap is a Poisson
weight of each row, from the row's key, the tree and the seed; classes are balanced within each tree's sample. Trees grow best
first: of all leaves the one whose split lowers the impurity most is split next, until there are ``leaves`` leaves. The order
is played on the driver with what is known; each round one job finds the best splits of all nodes, of all trees of all
problems, that the game needs next. Tasks count labels by node, feature and bin, Spark adds the counts, splits are chosen
where the sums are. Counts are whole numbers, so trees do not depend on the layout of rows.

A node looks at a random part of the features, drawn by its place in the tree, so trees do not depend on the order of work
either. Sets of problems with many trees are grown one after another (``TREES`` at a time).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.models.linear import ALL, Pool
from loomspark.operators.gram import HELD, STEP, Space, doubles

BINS = 64
#: Rows of a partition from which edges of bins are taken, about.
SAMPLE = 4000
#: Trees that are grown side by side.
TREES = 400
#: Depth that no tree passes: places of nodes are 64-bit numbers.
DEEPEST = 60

#: The seed that counts every row once, instead of a bootstrap.
EVERY_ROW = -1
# distribution of the Poisson weights with mean 1
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


@dataclass(frozen=True)
class Grow:
    """One forest: the rows of ``part`` but for those whose fold in ``split`` is ``left`` (ALL: none is left out)."""

    part: int
    split: int
    left: int
    trees: int = 100
    max_features: float | None = None
    leaves: int | None = None
    depth: int = DEEPEST
    balanced: bool = True
    seed: int = 42

    def looked_at(self, width: int) -> int:
        """Features that a node looks at."""
        share = math.sqrt(width) if self.max_features is None else self.max_features * width
        return min(width, max(1, int(share)))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words."""
    h = np.asarray(h, np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def weights(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Each row's Poisson weight in a tree's sample."""
    if seed == EVERY_ROW:
        return np.ones(len(h), np.int64)
    own = mixed(mixed(h) ^ mixed(np.uint64((seed % 2**32) * 1_000_003 + tree + 1)))
    return np.searchsorted(_POISSON, (own >> np.uint64(11)).astype(np.float64) / 2**53, "right")


def looked_at(seed: int, tree: int, nodes: list[int], width: int, n: int) -> np.ndarray:
    """The features that each node looks at, a row of ascending numbers for each."""
    if n >= width:
        return np.tile(np.arange(width), (len(nodes), 1))
    base = mixed(mixed(np.array(nodes, np.uint64)) ^ mixed(np.uint64((seed % 2**32) * 1_000_003 + tree + 1)) ^ np.uint64(0x5851F42D4C957F2D))
    order = mixed(mixed(np.arange(width, dtype=np.uint64) + np.uint64(1))[None] ^ base[:, None])
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :n], axis=1)


# ---- bins


@dataclass
class Binned:
    """Rows (partition_id, y, folds, h, bins), edges of each partition's bins, its space and how many columns of it are used."""

    rows: DataFrame
    edges: dict[int, list[np.ndarray]]
    space: dict[int, Space]
    width: dict[int, int]


def edges_of(z: np.ndarray) -> list[np.ndarray]:
    """For each column at most BINS - 1 edges, halfway between values."""
    out = []
    for k in range(z.shape[1]):
        v = np.unique(z[:, k])
        low = v[:-1]
        if len(v) > BINS:
            low = np.unique(np.quantile(z[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
            low = low[low < v[-1]]
        out.append((low + v[np.searchsorted(v, low, "right")]) / 2 if len(low) else np.zeros(0))
    return out


def binned(p: Pool, spaces: dict[int, Space], widths: dict[int, int]) -> Binned:
    """The pool's rows in each partition's space, cut into bins; persisted."""
    sizes = {part: sum(n for (q, s, _, _), n in p.counts.items() if q == part and s == 0) for part in p.parts}
    least = F.coalesce(*[F.when(F.col("partition_id") == part, F.lit(min(1.0, SAMPLE / n))) for part, n in sizes.items()])
    some = p.rows.filter(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < least * 1_000_000).select("partition_id", "x")

    def cut(t: pa.Table) -> pa.Table:
        part = t["partition_id"][0].as_py()
        found = edges_of(spaces[part].apply(doubles(t["x"].combine_chunks()))[:, : widths[part]])
        return pa.table({"partition_id": pa.array([part], pa.int32()), "edges": pa.array([found], pa.list_(pa.list_(pa.float64())))})

    rows = some.groupBy("partition_id").applyInArrow(cut, "partition_id int, edges array<array<double>>").collect()  # BINS values a column
    edges = {r["partition_id"]: [np.array(e, float) for e in r["edges"]] for r in rows}
    known = p.rows.sparkSession.sparkContext.broadcast((spaces, widths, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, widths, edges = known.value
        for b in batches:
            part, x = b.column(0).to_numpy(), doubles(b.column(4))
            out: list[bytes] = [b""] * len(x)
            for q in np.unique(part):
                own = np.flatnonzero(part == q)
                z = spaces[int(q)].apply(x[own])[:, : widths[int(q)]]
                bins = np.column_stack([np.searchsorted(e, z[:, k], "left") for k, e in enumerate(edges[int(q)])]).astype(np.uint8)
                for i, row in zip(own, bins, strict=True):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(out, pa.binary())], ["partition_id", "y", "folds", "h", "bins"])

    made = p.rows.select("partition_id", "y", "folds", "h", "x").mapInArrow(run, "partition_id int, y int, folds array<int>, h long, bins binary").persist()
    return Binned(made, edges, spaces, widths)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, y, folds, h, bins) of a few thousand rows of one partition each."""
    for b in batches:
        part, y, h = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy().view(np.uint64)
        folds, raw = doubles(b.column(2)).astype(int), b.column(4).to_pylist()
        for q in np.unique(part):
            own = np.flatnonzero(part == q)
            for at in range(0, len(own), STEP):
                rows = own[at : at + STEP]
                bins = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), -1)
                yield int(q), y[rows], folds[rows], h[rows], bins


# ---- trees


@dataclass
class Tree:
    """A tree while it grows. Nodes are numbered by place: 1, and below n 2 n and 2 n + 1.

    ``known``: a node's split (gain, feature, bin, counts of labels on the left, on the right) or None where it stays a leaf.
    """

    counts: dict[int, tuple[int, int]] = field(default_factory=dict)
    known: dict[int, tuple | None] = field(default_factory=dict)
    split: list[int] = field(default_factory=list)
    balance: tuple[float, float] | None = None

    def play(self, leaves: int | None, depth: int) -> list[int]:
        """Splits in best-first order as far as known; the nodes that have to be looked at to go on (none: the tree is whole)."""
        if 1 not in self.known:
            return [1]
        heap, wanted, self.split, exact = [], [], [], True
        budget = math.inf if leaves is None else leaves - 1
        if self.known[1] is not None:
            heap.append((-self.known[1][0], 1))
        while heap and budget > 0:
            _, node = heapq.heappop(heap)
            budget -= 1
            if exact:
                self.split.append(node)
            for child, counts in zip((2 * node, 2 * node + 1), self.known[node][3:], strict=True):
                if child in self.known:
                    if self.known[child] is not None:
                        heapq.heappush(heap, (-self.known[child][0], child))
                    continue
                self.counts[child] = counts
                if budget <= 0:
                    continue
                if min(counts) == 0 or child.bit_length() > depth:
                    self.known[child] = None
                    continue
                wanted.append(child)
                exact = False  # from here on the order is a guess; the game is played again when the child is known
        return wanted

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(feature, bin, left child, value) by number, -1 as feature of a leaf; the right child follows the left one."""
        inner = set(self.split)
        number, order = {1: 0}, [1]
        feature, cut, left, value = [], [], [], []
        for node in order:
            c0, c1 = self.counts[node]
            w0, w1 = c0 * self.balance[0], c1 * self.balance[1]
            value.append(w1 / (w0 + w1) if w0 + w1 else 0.5)
            if node in inner:
                for child in (2 * node, 2 * node + 1):
                    number[child] = len(order)
                    order.append(child)
                feature.append(self.known[node][1])
                cut.append(self.known[node][2])
                left.append(number[2 * node])
            else:
                feature.append(-1)
                cut.append(0)
                left.append(0)
        return np.array(feature, np.int32), np.array(cut, np.int32), np.array(left, np.int32), np.array(value)


def descend(flat: tuple, bins: np.ndarray) -> np.ndarray:
    """The number of the leaf of each row."""
    feature, cut, left, _ = flat
    at = np.zeros(len(bins), np.int32)
    moving = np.flatnonzero(feature[at] >= 0)
    while len(moving):
        node = at[moving]
        at[moving] = left[node] + (bins[moving, feature[node]] > cut[node])
        moving = moving[feature[at[moving]] >= 0]
    return at


def best_splits(hist: np.ndarray, balance: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of nodes' counts (node, feature, bin, label): gain (-inf without a split), place of the feature, bin, counts on the left.

    ``balance`` is each node's weight of the labels.
    """
    whole = hist[:, 0].sum(1)
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    w_all = whole * balance
    w_left = left * balance[:, None, None]
    w_right = w_all[:, None, None] - w_left
    n_left, n_all = left.sum(-1), whole.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (w_left**2).sum(-1) / w_left.sum(-1) + (w_right**2).sum(-1) / w_right.sum(-1)
        gain[(n_left == 0) | (n_left == n_all[:, None, None])] = -np.inf
        flat = gain.reshape(len(hist), -1)
        # of splits that are equal but for rounding the first
        top = flat.max(1)
        at = (flat >= top[:, None] - 1e-9 * np.maximum(1, np.abs(top[:, None]))).argmax(1)
        f, b = np.divmod(at, gain.shape[2])
        rows = np.arange(len(hist))
        return np.where(np.isfinite(top), gain[rows, f, b] - (w_all**2).sum(-1) / w_all.sum(-1), -np.inf), f, b, left[rows, f, b]


def _round(d: Binned, problems: list[Grow], trees: dict[tuple[int, int], Tree], wanted: dict[tuple[int, int], list[int]]) -> None:
    """Look at the wanted nodes of all trees, in one job."""
    game = {k: (_routing(trees[k], nodes), nodes) for k, nodes in wanted.items()}
    known = d.rows.sparkSession.sparkContext.broadcast(game)
    balances = {k: trees[k].balance for k in wanted}
    by_part: dict[int, list[tuple[int, int]]] = {}
    for j, tree in wanted:
        by_part.setdefault(problems[j].part, []).append((j, tree))
    width = d.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        drawn: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in held], pa.int64()) for i in range(3)], pa.array(list(held.values()), pa.list_(pa.float64()))], ["j", "tree", "node", "v"])
            held.clear()
            return made

        for part, y, folds, h, bins in _blocks(batches):
            for j, tree in by_part.get(part, ()):
                q = problems[j]
                (flat, slots), nodes = known.value[j, tree]
                w = weights(h, q.seed, tree)
                if q.left != ALL:
                    w = w * (folds[:, q.split] != q.left)
                slot = slots[descend(flat, bins)]
                at = np.flatnonzero((slot >= 0) & (w > 0))
                if not len(at):
                    continue
                n = q.looked_at(width[part])
                if (j, tree) not in drawn:
                    drawn[j, tree] = looked_at(q.seed, tree, nodes, width[part], n)
                features, own = drawn[j, tree], slot[at]
                cell = ((own[:, None] * n + np.arange(n)) * BINS + bins[at[:, None], features[own]]) * 2 + y[at][:, None]
                counts = np.bincount(cell.ravel(), np.repeat(w[at], n), len(nodes) * n * BINS * 2).reshape(len(nodes), -1)
                for s in np.unique(own):
                    key = (j, tree, int(nodes[s]))
                    old = held.get(key)
                    if old is None:
                        size += counts[s].nbytes
                    held[key] = counts[s] if old is None else old + counts[s]
            if size > HELD:
                yield out()
                size = 0
        if held:
            yield out()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = list(zip(*[b.column(i).to_pylist() for i in range(3)], strict=True))
            sizes = [problems[j].looked_at(width[problems[j].part]) for j, _, _ in own]
            rows: list[tuple] = [()] * len(own)
            for n in sorted(set(sizes)):
                at = [i for i, s in enumerate(sizes) if s == n]
                for k in range(0, len(at), 512):
                    part = at[k : k + 512]
                    hist = doubles(b.column(3).take(pa.array(part))).reshape(len(part), n, BINS, 2)
                    whole = hist[:, 0].sum(1)
                    balance = np.array([balances[own[i][:2]] or _balance(c, problems[own[i][0]].balanced) for i, c in zip(part, whole, strict=True)])
                    gain, f, cut, left = best_splits(hist, balance)
                    for x, i in enumerate(part):
                        j, tree, node = own[i]
                        rows[i] = (j, tree, node, int(whole[x, 0]), int(whole[x, 1]), *([None] * 7))
                        if whole[x].min() > 0 and np.isfinite(gain[x]):
                            feature = int(looked_at(problems[j].seed, tree, [node], width[problems[j].part], n)[0, f[x]])
                            right = whole[x] - left[x]
                            rows[i] = (*rows[i][:5], float(gain[x]), feature, int(cut[x]), *(int(v) for v in (*left[x], *right)))
            kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["j", "tree", "node", "c0", "c1", "gain", "feature", "bin", "l0", "l1", "r0", "r1"])

    rows = d.rows if sorted(by_part) == sorted(d.space) else d.rows.filter(F.col("partition_id").isin(list(by_part)))
    added = rows.mapInArrow(sums, "j long, tree long, node long, v array<double>").groupBy("j", "tree", "node").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    found = added.mapInArrow(best, "j long, tree long, node long, c0 long, c1 long, gain double, feature long, bin long, l0 long, l1 long, r0 long, r1 long")
    met = set()
    for r in found.collect():  # a row for each node
        t = trees[r["j"], r["tree"]]
        t.counts[r["node"]] = (r["c0"], r["c1"])
        if t.balance is None:
            t.balance = _balance(np.array([r["c0"], r["c1"]]), problems[r["j"]].balanced)
        t.known[r["node"]] = None if r["gain"] is None else (r["gain"], r["feature"], r["bin"], (r["l0"], r["l1"]), (r["r0"], r["r1"]))
        met.add((r["j"], r["tree"], r["node"]))
    for (j, tree), nodes in wanted.items():  # a tree whose sample is empty
        for node in nodes:
            if (j, tree, node) not in met:
                trees[j, tree].counts[node], trees[j, tree].known[node] = (0, 0), None
                trees[j, tree].balance = trees[j, tree].balance or (1.0, 1.0)
    known.unpersist()


def _balance(counts: np.ndarray, balanced: bool) -> tuple[float, float]:
    if not balanced or counts.min() == 0:
        return 1.0, 1.0
    return float(counts.sum() / (2 * counts[0])), float(counts.sum() / (2 * counts[1]))


def _routing(t: Tree, nodes: list[int]) -> tuple[tuple, np.ndarray]:
    """A tree whose leaves are what is not split on the way to the wanted nodes, and the wanted node's place for each leaf."""
    if nodes == [1]:
        return (np.full(1, -1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32), None), np.zeros(1, np.int64)
    inner = set()
    for node in nodes:
        node >>= 1
        while node and node not in inner:
            inner.add(node)
            node >>= 1
    order, number = [1], {1: 0}
    feature, cut, left, slot = [], [], [], []
    place = {n: i for i, n in enumerate(nodes)}
    for node in order:
        slot.append(place.get(node, -1))
        if node in inner:
            number[2 * node] = len(order)
            order += [2 * node, 2 * node + 1]
            feature.append(t.known[node][1])
            cut.append(t.known[node][2])
            left.append(number[2 * node])
        else:
            feature.append(-1)
            cut.append(0)
            left.append(0)
    return (np.array(feature, np.int32), np.array(cut, np.int32), np.array(left, np.int32), None), np.array(slot, np.int64)


Flat = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def grow(d: Binned, problems: list[Grow]) -> list[Flat]:
    """Each problem's trees."""
    out: list[Flat] = []
    at = 0
    while at < len(problems):
        end, n = at, 0
        while end < len(problems) and (end == at or n + problems[end].trees <= TREES):
            n += problems[end].trees
            end += 1
        own = problems[at:end]
        trees = {(j, k): Tree() for j, q in enumerate(own) for k in range(q.trees)}
        open_ = set(trees)
        while open_:
            wanted = {}
            for k in sorted(open_):
                q = own[k[0]]
                if nodes := trees[k].play(q.leaves, min(q.depth, DEEPEST)):
                    wanted[k] = nodes
                else:
                    open_.discard(k)
            if wanted:
                _round(d, own, trees, wanted)
        out += [[trees[j, k].flat() for k in range(q.trees)] for j, q in enumerate(own)]
        at = end
    return out


def best_split(d: Binned, q: Grow) -> tuple:
    """(gain, feature, bin, counts left, counts right) of the best split of all rows, each counted once, over all features."""
    t = Tree()
    _round(d, [Grow(q.part, q.split, q.left, 1, 1.0, balanced=q.balanced, seed=EVERY_ROW)], {(0, 0): t}, {(0, 0): [1]})
    return t.known[1]


def forest_scores(trees: Flat, bins: np.ndarray) -> np.ndarray:
    """The mean over the trees of the share of label 1 in a row's leaf."""
    return sum(t[3][descend(t, bins)] for t in trees) / len(trees)


def held_scores(d: Binned, problems: list[Grow], grown: list[Flat]) -> DataFrame:
    """(j, y, p1): each problem's scores of the rows that it left out; of all its partition's rows where it left out none."""
    known = d.rows.sparkSession.sparkContext.broadcast(grown)
    by_part: dict[int, list[int]] = {}
    for j, q in enumerate(problems):
        by_part.setdefault(q.part, []).append(j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y, folds, _, bins in _blocks(batches):
            for j in by_part.get(part, ()):
                q = problems[j]
                at = np.flatnonzero(folds[:, q.split] == q.left) if q.left != ALL else np.arange(len(y))
                if len(at):
                    p1 = forest_scores(known.value[j], bins[at])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p1), j, np.int32)), pa.array(y[at].astype(np.int32)), pa.array(p1)], ["j", "y", "p1"])

    return d.rows.filter(F.col("partition_id").isin(list(by_part))).mapInArrow(run, "j int, y int, p1 double")


@dataclass
class Forest:
    """A grown forest over features as they are: its space, how many columns of it are used, edges of bins, trees, calibration."""

    space: Space
    width: int
    edges: list[np.ndarray]
    trees: Flat
    slope: float
    intercept: float
    recorded: dict

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = self.space.apply(x)[:, : self.width]
        bins = np.column_stack([np.searchsorted(e, z[:, k], "left") for k, e in enumerate(self.edges)]) if len(self.edges) else np.zeros((len(x), 0), int)
        return forest_scores(self.trees, bins)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * self.raw(x))))
