"""Gradient boosting of many models at once, by histograms.

A model whose training rows are few enough for one task (``Settings.alone``) is
grown by that task, all rounds of it; the models of a pool are such tasks of one
job.  Models of more rows grow together, level by level: one job handles one level
of one tree of all of them, so the number of jobs is rounds times depth, whatever
the number of models.  Both grow the same trees.

* ``binned_rows`` cuts every feature into bins at quantiles of the model's own
  training rows (missing values at their exact median), once.
* Level by level, the training rows lie in blocks of one group, cached, with their
  scores; a round's trees are added to the scores once.  A job works out each row's
  node in the tree that grows, sums gradients, hessians and counts per (model, node,
  feature, bin), adds up the parts of a (model, node) where its best split is then
  chosen.  Only the splits reach the driver.
* In one task, the sums of a split node's larger child are the node's own without
  those of the smaller one.
* Gains are second order with L1 and L2 terms: ``T(G)^2 / (H + l2)``,
  ``T(G)`` being ``G`` drawn towards zero by ``l1``; a leaf is ``-T(G) / (H + l2)``
  times the learning rate.
* Trees grow leaf by leaf, the largest gain first, up to ``leaves`` leaves and
  ``depth`` levels.  A node's gain does not depend on the order, so the levels are
  evaluated in full and the order is applied to them afterwards.

The blocks are written to the checkpoint folder every ``KEEP`` rounds, so a lost
executor repeats no more than those, or one model; the files of the rounds before
are deleted, and so are a level's shuffle files."""
from __future__ import annotations

import heapq
import sys
import zlib
from dataclasses import dataclass, field
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadforge.session import ensure_checkpoint_dir, materialize

# functions of this module run in Python workers: they are sent by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEEP = 10
#: rows of a block
BLOCK = 16_384
#: bytes of training rows that a task of a level should meet
PART_BYTES = 32 << 20
#: cells (rows times features) that are counted or scored at once
CELLS = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``alone``: up to so many training rows, a model is grown by one task."""
    rounds: int = 50
    rate: float = 0.03
    depth: int = 6
    leaves: int = 63
    min_rows: int = 30
    min_hessian: float = 1e-3
    columns: float = 0.7
    l1: float = 0.1
    l2: float = 1.0
    bins: int = 64
    seed: int = 42
    alone: int = 0


def _frozen(tree: dict) -> bytes:
    return zlib.compress(b"".join(tree[k].tobytes() for k in ("value", "feature", "bin")), 1)


def _thawed(data: bytes) -> dict:
    raw = zlib.decompress(data)
    size = len(raw) // 13
    return {"feature": np.frombuffer(raw, np.int32, size, 8 * size), "bin": np.frombuffer(raw, np.uint8, size, 12 * size), "value": np.frombuffer(raw, np.float64, size)}


class Trees(Sequence):
    """Trees, held and sent in few bytes."""

    def __init__(self):
        self.frozen: list[bytes] = []

    def __len__(self):
        return len(self.frozen)

    def __getitem__(self, at):
        return [_thawed(t) for t in self.frozen[at]] if isinstance(at, slice) else _thawed(self.frozen[at])

    def append(self, tree: dict):
        self.frozen.append(_frozen(tree))


@dataclass
class Model:
    """``group``: whose rows it learns from; ``target``: ``up`` (a probability)
    or ``size`` (a value); ``allowed``: the features it may use; ``key``: what
    its draws of features depend on beside the seed, so that they are the same
    in any pool."""
    group: int
    target: str
    allowed: list[int]
    key: int = 0
    start: float = 0.0
    trees: Trees = field(default_factory=Trees)

    def split_counts(self, n_features: int) -> np.ndarray:
        used = np.concatenate([t["feature"][t["feature"] >= 0] for t in self.trees]) if self.trees else np.empty(0, np.int64)
        return np.bincount(used, minlength=n_features)


def _matrix(x, rows: int, n_features: int) -> np.ndarray:
    return np.array(x.flatten().fill_null(np.nan), np.float64).reshape(rows, n_features)


def cut_points(train: DataFrame, n_features: int, bins: int) -> dict[int, list[np.ndarray]]:
    """The different cuts of every group and feature: quantiles (rank error
    1/1000) of the present values."""
    clean = [F.when(~F.isnan(F.get("x", F.lit(j))), F.get("x", F.lit(j))) for j in range(n_features)]
    probs = [(k + 1) / bins for k in range(bins - 1)]
    cuts = train.groupBy("group").agg(F.array(*[F.coalesce(F.percentile_approx(c, probs, 1000), F.array().cast("array<double>")) for c in clean]).alias("cuts"))
    # a row per group of the pool, a number per feature and cut: the pool's size, not the table's
    return {r["group"]: [np.unique(np.array(c)) for c in r["cuts"]] for r in cuts.collect()}


def medians(train: DataFrame, n_features: int, cuts: dict[int, list[np.ndarray]]) -> dict[int, dict[int, float]]:
    """Exact median by group and feature; missing everywhere: none.  The values
    between neighbouring cuts are counted, and only those of the parts that
    hold a middle rank are exchanged, equal ones once a task."""
    width = 1 + max((len(e) for edges in cuts.values() for e in edges), default=0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = np.array(batch.column(0))
            x = _matrix(batch.column(1), len(groups), n_features)
            for g in np.unique(groups).tolist():
                mine = x[groups == g]
                part = found.setdefault(g, np.zeros((n_features, width)))
                for j in range(n_features):
                    v = mine[:, j]
                    part[j] += np.bincount(np.searchsorted(cuts[g][j], v[~np.isnan(v)], side="left"), minlength=width)
        for g, part in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([part.ravel()], pa.list_(pa.float64()))], names=["group", "counts"])

    rows = train.select(F.col("group").cast("int").alias("group"), "x")
    parts = rows.mapInArrow(count, "group int, counts array<double>")
    added = parts.select("group", F.posexplode("counts").alias("at", "n")).where("n > 0").groupBy("group", "at").agg(F.sum("n").alias("n"))
    counts: dict[int, np.ndarray] = {g: np.zeros((n_features, width)) for g in cuts}
    found = added.toArrow()                                     # the pool's size again
    group, at, n = (found.column(k).to_numpy() for k in ("group", "at", "n"))
    for g in np.unique(group).tolist():
        counts[g].ravel()[at[group == g]] = n[group == g]
    first, last, ranks = {}, {}, []
    for g, c in counts.items():
        total, upto = c.sum(1), np.cumsum(c, axis=1)
        low, high = np.floor((total - 1) / 2), np.ceil((total - 1) / 2)
        first[g], last[g] = (upto <= low[:, None]).sum(1), (upto <= high[:, None]).sum(1)
        for j in np.flatnonzero(total):
            below = upto[j, first[g][j] - 1] if first[g][j] else 0.0
            ranks.append((int(g), int(j), int(low[j] - below), int(high[j] - below)))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column(0))
            x = _matrix(batch.column(1), len(groups), n_features)
            for g in np.unique(groups).tolist():
                mine = x[groups == g]
                for j in range(n_features):
                    v = mine[:, j]
                    v = v[~np.isnan(v)]
                    at = np.searchsorted(cuts[g][j], v, side="left")
                    value, n = np.unique(v[(at >= first[g][j]) & (at <= last[g][j])], return_counts=True)
                    if len(value):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), g), pa.int32()), pa.array(np.full(len(value), j), pa.int32()),
                                                          pa.array(value), pa.array(n, pa.int64())], names=["group", "column", "value", "n"])

    if not ranks:
        return {}
    values = rows.mapInArrow(inside, "group int, column int, value double, n long").groupBy("group", "column", "value").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("group", "column").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = train.sparkSession.createDataFrame(ranks, "group int, column int, low long, high long")
    ends = values.withColumn("upto", upto).join(wanted, ["group", "column"]).groupBy("group", "column").agg(
        F.min(F.when(F.col("upto") > F.col("low"), F.col("value"))).alias("lo"), F.min(F.when(F.col("upto") > F.col("high"), F.col("value"))).alias("hi"))
    out: dict[int, dict[int, float]] = {}
    for r in ends.collect():
        out.setdefault(r["group"], {})[r["column"]] = r["lo"] if r["lo"] == r["hi"] else r["lo"] + (r["hi"] - r["lo"]) * 0.5
    return out


def binned_rows(rows: DataFrame, n_features: int, bins: int) -> DataFrame:
    """``rows`` (``group, train, y, size, x`` and whatever else) with ``x`` as
    one byte a feature.  The cuts of a group are quantiles of its training rows
    (rank error 1/1000); a value above k cuts is in bin k."""
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    train = rows.where("train")
    cuts = cut_points(train, n_features, bins)
    middle = medians(train, n_features, cuts)
    out = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column("group"))
            flat = _matrix(batch.column("x"), len(groups), n_features)
            made = np.zeros(flat.shape, np.uint8)
            for g in np.unique(groups).tolist():
                at = np.flatnonzero(groups == g)
                known = middle.get(g, {})
                for j in range(n_features):
                    v = flat[at, j]
                    v = np.where(np.isnan(v), known.get(j, 0.0), v)
                    made[at, j] = np.searchsorted(cuts[g][j], v, side="left")
            data = [pa.array([r.tobytes() for r in made], pa.binary()) if n == "x" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(data, names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` " + ("binary" if f.name == "x" else f.dataType.simpleString()) for f in out)
    return rows.mapInArrow(run, schema)


def stacked(trees: Sequence[dict]) -> dict:
    """The trees as one array a part, a row for each tree."""
    return {k: np.stack([t[k] for t in trees]) for k in ("feature", "bin", "value")}


def apply_trees(trees: Sequence[dict], x: np.ndarray) -> np.ndarray:
    """Sum of the leaves that the rows of bins ``x`` reach."""
    return apply_stacked(stacked(trees), x) if len(trees) else np.zeros(len(x))


def apply_stacked(forest: dict, x: np.ndarray) -> np.ndarray:
    out, rows = np.zeros(len(x)), np.arange(len(x))
    step = max(1, CELLS // max(len(x), 1))
    for lo in range(0, len(forest["value"]), step):
        feature, cut, value = (forest[k][lo:lo + step] for k in ("feature", "bin", "value"))
        first = (np.arange(len(value)) * value.shape[1])[:, None]
        feature, cut, value = feature.ravel(), cut.ravel(), value.ravel()
        node = np.ones((len(first), len(x)), np.int64)
        while True:
            at = first + node
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            node = np.where(inner, 2 * node + (x[rows, np.maximum(f, 0)] > cut[at]), node)
        out += value[at].sum(0)
    return out


def node_of(tree: dict, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    while True:
        f = tree["feature"][node]
        inner = f >= 0
        if not inner.any():
            return node
        node = np.where(inner, 2 * node + (x[rows, np.maximum(f, 0)] > tree["bin"][node]), node)


def _empty_tree(depth: int) -> dict:
    size = 2 << depth
    return {"feature": np.full(size, -1, np.int32), "bin": np.zeros(size, np.uint8), "value": np.zeros(size)}


def shrunk(g, s: Settings):
    return np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0)


def best_split(sums: np.ndarray, s: Settings):
    """``sums``: (feature, bin, [G, H, n]) of one node.  The feature, bin, gain
    and both sides' sums of the best split, or None."""
    return best_splits(sums[None], s)[0]


def best_splits(sums: np.ndarray, s: Settings) -> list:
    """The best split of each node of (node, feature, bin, [G, H, n])."""
    parts = [np.ascontiguousarray(sums[..., k]) for k in range(3)]
    total = [p[:, :1].sum(2, keepdims=True) for p in parts]
    left = [np.cumsum(p[..., :-1], axis=2) for p in parts]
    right = [t - p for t, p in zip(total, left)]

    def score(part):
        return np.maximum(np.abs(part[0]) - s.l1, 0.0) ** 2 / (part[1] + s.l2)

    gain = score(left) + score(right) - score(total)
    ok = (left[2] >= s.min_rows) & (right[2] >= s.min_rows) & (left[1] >= s.min_hessian) & (right[1] >= s.min_hessian)
    gain = np.where(ok & (gain > 1e-12), gain, -np.inf)
    out = []
    for k in range(len(gain)):
        if gain[k].size == 0 or gain[k].max() == -np.inf:
            out.append(None)
            continue
        f, b = divmod(int(np.argmax(gain[k])), gain.shape[2])
        out.append((f, b, float(gain[k, f, b]), np.array([p[k, f, b] for p in left]), np.array([p[k, f, b] for p in right])))
    return out


def leaf_first(splits: dict[int, tuple], leaves: int) -> set[int]:
    """The nodes that are split when the leaf of the largest gain goes first,
    until there are ``leaves`` leaves."""
    taken: set[int] = set()
    queue = [(-splits[1][0], 1)] if 1 in splits else []
    while queue and len(taken) < leaves - 1:
        _, node = heapq.heappop(queue)
        taken.add(node)
        for child in (2 * node, 2 * node + 1):
            if child in splits:
                heapq.heappush(queue, (-splits[child][0], child))
    return taken


def _drawn(allowed: Sequence[int], key: int, r: int, s: Settings) -> np.ndarray:
    """The features that a model's tree of round ``r`` may use."""
    return np.sort(np.random.default_rng([s.seed, r, key]).choice(allowed, max(1, round(s.columns * len(allowed))), replace=False))


def _finished(splits: dict[int, tuple], s: Settings) -> dict:
    """The tree of ``splits`` (gain, feature, bin, both sides' sums by node)."""
    tree, taken = _empty_tree(s.depth), leaf_first(splits, s.leaves)
    for k in taken:
        _, feature, at, left, right = splits[k]
        tree["feature"][k], tree["bin"][k] = feature, at
        for child, (g, h, _) in ((2 * k, left), (2 * k + 1, right)):
            if child not in taken:
                tree["value"][child] = -s.rate * shrunk(g, s) / (h + s.l2)
    return tree


def _gradients(target: str, score: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """First and second derivatives; no second ones: ones."""
    if target == "up":
        p = 1 / (1 + np.exp(-score))
        return p - y, p * (1 - p)
    return score - size, None


#: rows of one group: ``x`` by row and feature
PACKED = "group int, n int, x binary, y binary, size binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = np.array(batch.column(0))
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(groups), -1) if len(groups) else None
        y, size = (np.array(batch.column(k), np.float64) for k in (2, 3))
        for g in np.unique(groups).tolist():
            at = np.flatnonzero(groups == g)
            cells = [[g], [len(at)], [x[at].tobytes()], [y[at].tobytes()], [size[at].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.int32()] * 2 + [pa.binary()] * 3)], names=["group", "n", "x", "y", "size"])


def _joined(held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed rows ``(n, x, y, size)``, ``x`` by feature and row."""
    x = np.concatenate([np.frombuffer(bytes(x), np.uint8).reshape(n, -1) for n, x, _, _ in held])
    y, size = (np.concatenate([np.frombuffer(bytes(h[c]), np.float64) for h in held]) for c in (2, 3))
    return np.ascontiguousarray(x.T), y, size


def _training(binned: DataFrame, groups: Sequence[int]) -> DataFrame:
    return binned.where("train").where(F.col("group").isin(list(groups))).select(
        F.col("group").cast("int").alias("group"), "x", F.col("y").cast("double").alias("y"), F.col("size").cast("double").alias("size"))


def _blocks(binned: DataFrame, starts: dict[tuple[int, str], float]):
    """The training rows as an RDD of blocks ``(group, x, y, size, scores)``: rows
    of one group, ``x`` by feature and row, scores by target.  Large groups lie in
    several tasks, and a task meets few groups."""
    sc = binned.sparkSession.sparkContext

    def merged(rows):
        held = []

        def block():
            g = held[0]["group"]
            x, y, size = _joined([(r["n"], r["x"], r["y"], r["size"]) for r in held])
            return (g, x, y, size, {t: np.full(len(y), starts[g, t]) for t in ("up", "size") if (g, t) in starts})

        for r in rows:
            if held and (held[0]["group"] != r["group"] or sum(h["n"] for h in held) + r["n"] > BLOCK):
                yield block()
                held = []
            held.append(r)
        if held:
            yield block()

    train = _training(binned, {g for g, _ in starts})
    weight = train.agg(F.sum(F.length("x") + 40)).head()[0] or 0
    parts = max(sc.defaultParallelism, weight // PART_BYTES + 1)
    dealt = train.repartitionByRange(parts, "group", F.xxhash64("x", "y", "size")).sortWithinPartitions("group")
    return dealt.mapInArrow(_pack, PACKED).rdd.mapPartitions(merged)


def histograms(x: np.ndarray, columns: np.ndarray, at: np.ndarray | None, slot: np.ndarray, slots: int, grad: np.ndarray, hess: np.ndarray | None, bins: int) -> np.ndarray:
    """(slot, column, bin, [G, H, n]) of the rows ``at`` (None: all), whose node is ``slot``; no ``hess``: ones."""
    out = np.empty((3, slots, len(columns), bins))
    first, width = slot * bins, slots * bins
    step = max(1, CELLS // max(len(slot), 1))
    for lo in range(0, len(columns), step):
        some = columns[lo:lo + step]
        cell = x[some] if at is None else x[some[:, None], at]
        cell = (first + cell + (np.arange(len(some)) * width)[:, None]).ravel()
        for k, weight in enumerate((grad, hess, None)):
            if k != 1 or hess is not None:
                weight = weight if weight is None else np.broadcast_to(weight, (len(some), len(slot))).ravel()
                out[k, :, lo:lo + step] = np.bincount(cell, weight, len(some) * width).reshape(len(some), slots, bins).swapaxes(0, 1)
    if hess is None:
        out[1] = out[2]
    return np.moveaxis(out, 0, -1)


def _grow(x: np.ndarray, y: np.ndarray, size: np.ndarray, target: str, allowed: Sequence[int], key: int, start: float, s: Settings) -> list[bytes]:
    """All trees of a model (frozen) from its training rows, ``x`` by feature and row."""
    score, trees = np.full(len(y), start), []
    for r in range(s.rounds):
        columns, splits, tree = _drawn(allowed, key, r, s), {}, _empty_tree(s.depth)
        grad, hess = _gradients(target, score, y, size)
        node, nodes = np.ones(len(y), np.int64), [1]
        sums = histograms(x, columns, None, node - 1, 1, grad, hess, s.bins)
        for level in range(1, s.depth + 1):
            # place of the split node, its smaller child, its larger one, whether the smaller one may be split too
            below = []
            for i, (k, got) in enumerate(zip(nodes, best_splits(sums, s))):
                if got:
                    f, b, gain, left, right = got
                    tree["feature"][k], tree["bin"][k] = columns[f], b
                    splits[k] = gain, int(columns[f]), b, left, right
                    few, many = (2 * k, 2 * k + 1) if left[2] <= right[2] else (2 * k + 1, 2 * k)
                    if max(left[2], right[2]) >= 2 * s.min_rows:
                        below.append((i, few, many, min(left[2], right[2]) >= 2 * s.min_rows))
            if not below or level == s.depth:
                break
            moved = np.flatnonzero(tree["feature"][node] >= 0)
            k = node[moved]
            node[moved] = 2 * k + (x[tree["feature"][k], moved] > tree["bin"][k])
            place = np.full(len(tree["feature"]), -1, np.int64)
            place[[few for _, few, _, _ in below]] = np.arange(len(below))
            at = np.flatnonzero(place[node] >= 0)
            fewer = histograms(x, columns, at, place[node[at]], len(below), grad[at], hess if hess is None else hess[at], s.bins)
            both = [j for j, b in enumerate(below) if b[3]]
            sums = np.concatenate([fewer[both], sums[[i for i, _, _, _ in below]] - fewer])
            nodes = [below[j][1] for j in both] + [many for _, _, many, _ in below]
        tree = _finished(splits, s)
        trees.append(_frozen(tree))
        score = score + apply_trees([tree], x.T)
    return trees


def _collected(rdd) -> list:
    """The rows; the shuffle files that were written for them are deleted."""
    rows = rdd.collect()
    cleaner, left = rdd.ctx._jsc.sc().cleaner(), [rdd._jrdd.rdd()]
    while left and cleaner.isDefined():
        needs = left.pop().dependencies()
        for need in (needs.apply(k) for k in range(needs.size())):
            if need.getClass().getSimpleName() == "ShuffleDependency":
                cleaner.get().doCleanupShuffle(need.shuffleId(), False)
            else:
                left.append(need.rdd())
    return rows


def _grow_alone(binned: DataFrame, models: Sequence[Model], s: Settings, rows: dict[int, int]) -> None:
    """Every model in a task of its own (in place), those of most rows first."""
    order = sorted(models, key=lambda m: -rows[m.group])
    asked = [(m.target, m.allowed, m.key, m.start) for m in order]
    of: dict[int, list[int]] = {}
    for i, m in enumerate(order):
        of.setdefault(m.group, []).append(i)

    def dealt(r):
        return [(i, (r["n"], bytes(r["x"]), bytes(r["y"]), bytes(r["size"]))) for i in of[r["group"]]]

    def run(parts):
        held: dict[int, list[tuple]] = {}
        for i, part in parts:
            held.setdefault(i, []).append(part)
        for i in sorted(held):
            # in one order, however they arrived
            yield i, _grow(*_joined(sorted(held.pop(i))), *asked[i], s)

    packed = _training(binned, of).mapInArrow(_pack, PACKED).rdd
    for i, trees in _collected(packed.flatMap(dealt).partitionBy(len(order), int).mapPartitions(run)):      # the models themselves
        order[i].trees.frozen += trees


def _level(state, models: list[Model], growing: list[dict], columns: list[np.ndarray], nodes: list[list[int]], s: Settings, parts: int) -> list:
    """Best splits of the given nodes of every model: one job."""
    # only what the tasks need, pickled once for all of them
    work: dict[int, list[tuple]] = {}
    for m, model in enumerate(models):
        if nodes[m]:
            work.setdefault(model.group, []).append((m, model.target, growing[m], columns[m], np.array(sorted(nodes[m]))))
    chosen = {m: columns[m] for m in range(len(models)) if nodes[m]}

    def sums(blocks):
        found: dict[tuple[int, int], np.ndarray] = {}
        for group, x, y, size, score in blocks:
            rows = np.arange(len(y))
            for m, target, tree, cols, active in work.get(group, ()):
                place = np.full(len(tree["feature"]), -1, np.int64)
                place[active] = np.arange(len(active))
                slot = place[node_of(tree, x.T, rows)]
                at = np.flatnonzero(slot >= 0)
                if not len(at):
                    continue
                grad, hess = _gradients(target, score[target][at], y[at], size[at])
                part = histograms(x, cols, None if len(at) == len(rows) else at, slot[at], len(active), grad, hess, s.bins)
                for k in np.unique(slot[at]).tolist():
                    key = m, int(active[k])
                    if key in found:
                        found[key] += part[k]
                    else:
                        found[key] = part[k].copy()
        return found.items()

    def choose(added):
        for (m, k), part in added:
            got = best_split(part, s)
            if got:
                f, b, gain, left, right = got
                yield m, k, int(chosen[m][f]), b, gain, tuple(map(float, left)), tuple(map(float, right))

    return _collected(state.mapPartitions(sums).reduceByKey(np.add, parts).mapPartitions(choose))        # a row for each node of the level


def fit(binned: DataFrame, models: list[Model], s: Settings = Settings()) -> DataFrame:
    """Grow ``s.rounds`` trees of every model (in place).  Returns the rows with
    their scores ``up`` and ``value``."""
    ensure_checkpoint_dir(binned.sparkSession)
    starts = {r["group"]: r for r in binned.where("train").groupBy("group").agg(
        F.avg("y").alias("y"), F.avg("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    for m in models:
        row = starts[m.group]
        share = min(max(row["y"], 1e-15), 1 - 1e-15)
        m.start = float(np.log(share / (1 - share))) if m.target == "up" else float(row["size"])
    rows = {g: r["n"] for g, r in starts.items()}
    alone, level = ([m for m in models if (rows[m.group] <= s.alone) == small] for small in (True, False))
    if alone:
        _grow_alone(binned, alone, s, rows)
    if level:
        _grow_level(binned, level, s)
    return materialize(_scored(binned.withColumns({"up": F.lit(0.0), "value": F.lit(0.0)}), models, 0))


def _grow_level(binned: DataFrame, models: list[Model], s: Settings) -> None:
    """All models level by level (in place)."""
    spark = binned.sparkSession
    blocks = _blocks(binned, {(m.group, m.target): m.start for m in models}).persist(StorageLevel.MEMORY_AND_DISK)
    parts = min(blocks.getNumPartitions(), max(spark.sparkContext.defaultParallelism, 2 * len(models)))
    state, before, kept = blocks, None, None
    for r in range(s.rounds):
        columns = [_drawn(m.allowed, m.key, r, s) for m in models]
        growing, nodes = [_empty_tree(s.depth) for _ in models], [[1] for _ in models]
        splits: list[dict[int, tuple]] = [{} for _ in models]
        for _ in range(s.depth):
            if not any(nodes):
                break
            rows = _level(state, models, growing, columns, nodes, s, parts)
            if before is not None:                  # the blocks of this round are kept now
                before.unpersist()
                before = None
                if state.getCheckpointFile():
                    _delete(spark, kept)
                    kept = state.getCheckpointFile()
            nodes = [[] for _ in models]
            for m, k, feature, at, gain, left, right in rows:
                splits[m][k] = gain, feature, at, left, right
                growing[m]["feature"][k], growing[m]["bin"][k] = feature, at
                nodes[m] += [c for c, side in ((2 * k, left), (2 * k + 1, right)) if side[2] >= 2 * s.min_rows]
        for m, model in enumerate(models):
            model.trees.append(_finished(splits[m], s))
        if r + 1 < s.rounds:
            before, state = state, _grown(state, models).persist(StorageLevel.MEMORY_AND_DISK)
            if (r + 1) % KEEP == 0:
                state.checkpoint()
    state.unpersist()
    if before is not None:
        before.unpersist()


def _delete(spark, folder: str | None) -> None:
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _grown(state, models: list[Model]):
    """The blocks with the last round's trees added to their scores."""
    last: dict[int, list[tuple]] = {}
    for m in models:
        last.setdefault(m.group, []).append((m.target, m.trees[-1]))

    def run(block):
        group, x, y, size, score = block
        return group, x, y, size, {t: score[t] + apply_trees([tree], x.T) for t, tree in last[group]}

    return state.map(run)


def _scored(state: DataFrame, models: list[Model], since: int) -> DataFrame:
    """The rows with the trees from round ``since`` on added to their scores."""
    recent = {(m.group, m.target): m.trees.frozen[since:] for m in models if len(m.trees) > since}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: dict[tuple[int, str], dict] = {}
        for batch in batches:
            groups = np.array(batch.column("group"))
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(len(groups), -1) if len(groups) else None
            score = {c: np.array(batch.column(c), np.float64) for c in ("up", "value")}
            for g in np.unique(groups).tolist():
                at = np.flatnonzero(groups == g)
                for column, target in (("up", "up"), ("value", "size")):
                    if (g, target) in recent:
                        if (g, target) not in forest:
                            forest[g, target] = stacked([_thawed(t) for t in recent[g, target]])
                        score[column][at] += apply_stacked(forest[g, target], x[at])
            yield pa.RecordBatch.from_arrays([pa.array(score[n]) if n in score else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return state.mapInArrow(run, state.schema)


def predictions(state: DataFrame, models: list[Model]) -> DataFrame:
    """The rows without ``x``, ``up`` as the probability of the upper class and
    ``value`` as the predicted size (NULL where no model has that target)."""
    def start(target):
        found = [F.when(F.col("group") == m.group, F.lit(m.start)) for m in models if m.target == target]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    score = F.col("up") + start("up")
    return state.withColumns({"up": F.lit(1.0) / (F.lit(1.0) + F.exp(-score)), "value": F.col("value") + start("size")}).drop("x")
