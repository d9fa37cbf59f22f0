"""Random forests of labelled rows, learnt level by level from histograms that Spark adds up.

Every value becomes the number of a bin between exact quantiles of its column.
A level of all trees is one pass over the binned rows: each task routes its rows
through the trees so far and counts, for each open node, feature and bin, the rows
of every class as often as the tree drew them; the counts are summed by Spark, and
one task for each tree picks the splits of least weighted Gini impurity. The driver
holds the trees alone, whose size depth and number bound.

A tree draws each row as often as a Poisson number told by a hash of the row's keys
and the tree, so reruns and lost tasks draw the same. Classes weigh inversely to
their rows among a tree's draws. A node looks at the root of the number of
features, in an order of its own, and goes on while none of them splits it. Rows a
tree did not draw are its out-of-bag rows, and vote for the error.

Null and non-finite values take their column's median. Rows without a label or
without a group learn nothing; a group of a single class or of too few rows has no
forest, and its rows get no probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvana.operators.isolation import _finite, _quantiles
from galvana.shared import cut


@dataclass(frozen=True)
class Settings:
    trees: int = 120
    depth: int = 10
    bins: int = 64
    least: int = 1  # draws in a leaf
    least_rows: int = 2
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; a leaf has feature -1, and ``share`` holds every node's class shares."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray


@dataclass(frozen=True)
class Forest:
    columns: tuple[str, ...]
    classes: tuple[str, ...]
    center: np.ndarray
    trees: tuple[Tree, ...]
    rows: int
    oob: float | None = None  # share of out-of-bag rows whose votes name their class

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares of the leaves that each row reaches."""
        x = np.where(np.isfinite(x), x, self.center)
        total = np.zeros((len(x), len(self.classes)))
        for t in self.trees:
            total += t.share[_reached(t, x)]
        return total / max(1, len(self.trees))


@dataclass(frozen=True)
class Forests:
    """A forest for each value of the column ``by`` (one for all rows where it is None)."""

    by: str | None
    members: dict[str, Forest]

    @property
    def classes(self) -> list[str]:
        return sorted({c for f in self.members.values() for c in f.classes})


def _reached(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), int)
    while True:
        rows = np.flatnonzero(tree.feature[node] >= 0)
        if not len(rows):
            return node
        at = node[rows]
        node[rows] = np.where(x[rows, tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws the rows of these 64-bit keys."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64) + np.uint64(seed % 2**32)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # scrambled bits of a public generator
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(np.float64) / 2**53, side="right")


def best_split(counts: np.ndarray, weight: np.ndarray, order: Sequence[int], tried: int, least: int) -> tuple[int, int] | None:
    """Feature and last bin to the left of the best split of a node's counts (features, bins, classes).

    Impurity is weighted Gini; of equal splits the earlier feature in ``order`` and the
    smaller bin count. Beyond the first ``tried`` features the next that splits at all ends the search.
    """
    best, found = 1e-12, None
    for k, f in enumerate(order):
        if k >= tried and found:
            break
        low = counts[f].cumsum(axis=0)[:-1]
        high = low[-1:] * 0 + counts[f].sum(axis=0) - low
        l, r = low * weight, high * weight
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (l * l).sum(axis=1) / l.sum(axis=1) + (r * r).sum(axis=1) / r.sum(axis=1)
        fits = (low.sum(axis=1) >= least) & (high.sum(axis=1) >= least)
        if not fits.any():
            continue
        whole = counts[f].sum(axis=0) * weight
        gain = np.where(fits, score - (whole * whole).sum() / whole.sum(), -np.inf)
        b = int(gain.argmax())
        if gain[b] > best * (1 + 1e-9):
            best, found = gain[b], (f, b)
    return found


class _Growing:
    """A tree in the making: bins instead of values, open nodes of the last level."""

    def __init__(self, classes: int) -> None:
        self.nodes: list[list[int]] = [[-1, 0, 0, 0]]  # feature, last bin to the left, children
        self.counts: list[np.ndarray] = [np.zeros(classes)]
        self.open = [0]

    def reached(self, bins: np.ndarray) -> np.ndarray:
        a = np.array(self.nodes)
        return _reached(Tree(a[:, 0], a[:, 1], a[:, 2], a[:, 3], a), bins)


def _binned(rows: DataFrame, columns: Sequence[str], cuts: dict, center: dict, groups: list[str], classes: dict) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, own in pdf.groupby("_g"):
                if name not in classes:
                    continue
                x = own[list(columns)].to_numpy(float)
                x = np.where(np.isfinite(x), x, center[name])
                bins = np.stack([np.searchsorted(cuts[name][k], x[:, k], side="left") for k in range(len(columns))], axis=1).astype(np.uint8)
                place = {c: k for k, c in enumerate(classes[name])}
                yield pd.DataFrame({"g": groups.index(name), "h": own["_h"], "y": own["_y"].map(place), "bins": [b.tobytes() for b in bins]})

    return rows.mapInPandas(run, "g int, h long, y int, bins binary")


def train(table: DataFrame, columns: Sequence[str], label: str, keys: Sequence[str], by: str | None = None, settings: Settings | None = None) -> Forests:
    """A forest for each value of ``by``; ``keys`` tell rows apart. Runs a job for each level of the trees.

    Labels and groups are few: their names travel with the model.
    """
    s = settings or Settings()
    group = F.col(by).cast("string") if by else F.lit("")
    rows = table.select(group.alias("_g"), F.col(label).cast("string").alias("_y"), F.xxhash64(*keys).alias("_h"), *(_finite(c).alias(c) for c in columns)).where("_g is not null and _y is not null")
    sizes: dict[str, dict[str, int]] = {}
    for r in rows.groupBy("_g", "_y").count().collect():
        sizes.setdefault(r["_g"], {})[r["_y"]] = r["count"]
    classes = {g: sorted(own) for g, own in sizes.items() if len(own) >= 2 and sum(own.values()) >= s.least_rows}
    if not classes:
        return Forests(by, {})
    groups = sorted(classes)
    n_bins, n_features = min(s.bins, 256), len(columns)
    long = rows.select("_g", F.posexplode(F.array(*columns)).alias("k", "value")).where("value is not null").select(F.concat_ws("\x00", "_g", "k").alias("name"), "value")
    found = _quantiles(long, [0.5, *(k / n_bins for k in range(1, n_bins))])
    center = {g: np.array([found.get(f"{g}\x00{k}", [0.0])[0] for k in range(n_features)]) for g in groups}
    cuts = {g: [np.unique(found.get(f"{g}\x00{k}", [0.0, 0.0])[1:]) for k in range(n_features)] for g in groups}
    binned = cut(_binned(rows, columns, cuts, center, groups, classes), "binned")
    trees = {(g, t): _Growing(len(classes[name])) for g, name in enumerate(groups) for t in range(s.trees)}
    weights: dict[tuple[int, int], np.ndarray] = {}
    tried = max(1, math.isqrt(n_features))
    for depth in range(s.depth + 1):
        growing = {k: t for k, t in trees.items() if t.open}
        if not growing:
            break
        for g, t, counts, splits in _level(binned, growing, weights, [len(classes[name]) for name in groups], n_features, n_bins, tried, depth == s.depth, s):
            tree = trees[g, t]
            if depth == 0:
                drawn = counts[0]
                weights[g, t] = np.where(drawn > 0, drawn.sum() / np.maximum(1, (drawn > 0).sum() * np.maximum(drawn, 1)), 0.0)
            after = []
            for node, own, (f, b) in zip(tree.open, counts, splits, strict=True):
                tree.counts[node] = own
                if f >= 0:
                    at = len(tree.nodes)
                    tree.nodes[node] = [f, b, at, at + 1]
                    tree.nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
                    tree.counts += [own * 0, own * 0]
                    after += [at, at + 1]
            tree.open = after
    members = {}
    for g, name in enumerate(groups):
        done = []
        for t in range(s.trees):
            tree = trees[g, t]
            a, own = np.array(tree.nodes), np.array(tree.counts) * weights.get((g, t), 1.0)
            value = np.array([cuts[name][f][b] if f >= 0 else 0.0 for f, b in a[:, :2]])
            done.append(Tree(a[:, 0], value, a[:, 2], a[:, 3], own / np.maximum(own.sum(axis=1, keepdims=True), 1e-300)))
        members[name] = Forest(tuple(columns), tuple(classes[name]), center[name], tuple(done), sum(sizes[name].values()))
    right = {r["g"]: r["right"] for r in _out_of_bag(binned, trees, weights, s).groupBy("g").agg(F.avg("hit").alias("right")).collect()}
    return Forests(by, {name: Forest(f.columns, f.classes, f.center, f.trees, f.rows, right.get(groups.index(name))) for name, f in members.items()})


def _arrays(pdf: pd.DataFrame, n_features: int) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, n_features)


def _level(binned: DataFrame, growing: dict, weights: dict, n_classes: list[int], n_features: int, n_bins: int, tried: int, last: bool, s: Settings):
    """Of every growing tree the class counts and splits of its open nodes."""
    spark = binned.sparkSession
    sent = spark.sparkContext.broadcast((growing, weights))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_trees, _ = sent.value
        for pdf in parts:
            for g, own in pdf.groupby("g"):
                bins, y, h, c = _arrays(own, n_features), own["y"].to_numpy(), own["h"].to_numpy(), n_classes[g]
                for (tg, t), tree in own_trees.items():
                    if tg != g:
                        continue
                    drawn = draws(h, t, s.seed)
                    slot = np.full(len(tree.nodes), -1)
                    slot[tree.open] = np.arange(len(tree.open))
                    at = slot[tree.reached(bins)]
                    rows = np.flatnonzero((drawn > 0) & (at >= 0))
                    cell = ((at[rows, None] * n_features + np.arange(n_features)) * n_bins + bins[rows]) * c + y[rows, None]
                    cells, where = np.unique(cell, return_inverse=True)
                    n = np.bincount(where.ravel(), np.repeat(drawn[rows], n_features), len(cells)).astype(np.int64)
                    yield pd.DataFrame({"g": g, "t": t, "cell": cells, "n": n})

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, t = key
        own_trees, own_weights = sent.value
        tree, c = own_trees[g, t], n_classes[g]
        counts = np.zeros(len(tree.open) * n_features * n_bins * c)
        counts[pdf["cell"].to_numpy()] = pdf["n"].to_numpy()
        counts = counts.reshape(len(tree.open), n_features, n_bins, c)
        totals = counts[:, 0].sum(axis=1)
        weight = own_weights.get((g, t))
        if weight is None:  # the root
            drawn = totals[0]
            weight = np.where(drawn > 0, drawn.sum() / np.maximum(1, (drawn > 0).sum() * np.maximum(drawn, 1)), 0.0)
        splits = []
        for node, own in zip(tree.open, counts, strict=True):
            order = np.random.default_rng([s.seed, g, t, node]).permutation(n_features)
            pure = (own[0].sum(axis=0) > 0).sum() < 2
            splits.append((-1, 0) if last or pure else best_split(own, weight, order.tolist(), tried, s.least) or (-1, 0))
        return pd.DataFrame({"g": [g], "t": [t], "counts": [totals.tobytes()], "splits": [np.array(splits, np.int64).tobytes()]})

    summed = binned.mapInPandas(count, "g int, t int, cell long, n long").groupBy("g", "t", "cell").agg(F.sum("n").alias("n"))
    for r in summed.groupBy("g", "t").applyInPandas(split, "g int, t int, counts binary, splits binary").collect():
        yield r["g"], r["t"], np.frombuffer(r["counts"]).reshape(-1, n_classes[r["g"]]), np.frombuffer(r["splits"], np.int64).reshape(-1, 2).tolist()


def _out_of_bag(binned: DataFrame, trees: dict, weights: dict, s: Settings) -> DataFrame:
    """``g, hit`` of every row that some tree did not draw: whether those trees' shares name its class."""
    sent = binned.sparkSession.sparkContext.broadcast((trees, weights))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_trees, own_weights = sent.value
        for pdf in parts:
            for g, own in pdf.groupby("g"):
                n_features = len(own["bins"].iloc[0])
                bins, h, y = _arrays(own, n_features), own["h"].to_numpy(), own["y"].to_numpy()
                votes, asked = None, np.zeros(len(y), int)
                for (tg, t), tree in own_trees.items():
                    if tg != g:
                        continue
                    counts = np.array(tree.counts) * own_weights.get((g, t), 1.0)
                    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
                    out = draws(h, t, s.seed) == 0
                    votes = np.zeros((len(y), share.shape[1])) if votes is None else votes
                    votes[out] += share[tree.reached(bins[out])]
                    asked += out
                hit = (votes.argmax(axis=1) == y)[asked > 0]
                yield pd.DataFrame({"g": g, "hit": hit.astype(float)})

    return binned.mapInPandas(run, "g int, hit double")


def probabilities(forests: Forests, table: DataFrame) -> Column:
    """A map of class and probability for each row of ``table``, without classes of probability 0; null without a forest."""
    sent = table.sparkSession.sparkContext.broadcast(forests)
    classes = forests.classes
    columns = next(iter(forests.members.values())).columns if forests.members else ()

    @F.pandas_udf("array<double>")
    def shares(group: pd.Series, *values: pd.Series) -> pd.Series:
        own = sent.value
        out = pd.Series([None] * len(group), dtype=object)
        x = np.stack([v.to_numpy(float) for v in values], axis=1)
        for name, forest in own.members.items():
            rows = np.flatnonzero((group == name).to_numpy())
            if len(rows):
                found = np.zeros((len(rows), len(classes)))
                found[:, [classes.index(c) for c in forest.classes]] = forest.probabilities(x[rows])
                for k, row in zip(rows.tolist(), found.tolist(), strict=True):
                    out[k] = row
        return out

    if not forests.members:
        return F.lit(None).cast("map<string,double>")
    group = F.col(forests.by).cast("string") if forests.by else F.lit("")
    found = shares(group, *(_finite(c) for c in columns))
    every = F.map_from_arrays(F.array(*map(F.lit, classes)), found)
    return F.map_filter(every, lambda _, p: p > 0)
