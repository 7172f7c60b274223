"""Boosted trees as Spark ML defines them, learned by tasks that stay: the rows are binned once and no job is needed for each level.

Spark ML starts a job for every level of every tree.  Here one barrier stage
holds the binned rows, and its tasks exchange histograms of the rows' gradients
among themselves: each task sums and judges its own share of the features.  Of
two siblings only the smaller is counted; the other one is the rest of the parent.
Loss, weights of trees, impurity and leaves are those of ``GBTClassifier``; the
result is a ``GBTClassificationModel``.
"""

from __future__ import annotations

import json
import secrets
import socket
import time
from collections.abc import Callable, Iterator
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import stage

#: Points that stand for a feature's values in a task, and those gathered before they are reduced to so many.
POINTS, GATHERED = 1 << 12, 1 << 16
#: Rows that a task can hold: two counts share a float.
MOST = 1 << 26
NODES = "treeID int, id int, prediction double, impurity double, weight double, total double, squares double, n long, gain double, left int, right int, feature int, threshold double"


# --- bins --------------------------------------------------------------------


def _columns(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    out = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]
    if any(np.isnan(c).any() for c in out):
        raise ValueError("a feature is null or NaN")
    return out


def _squeeze(values: np.ndarray, weights: np.ndarray, most: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their weights; beyond ``most``, the last value of each of so many groups of even weight."""
    values, where = np.unique(values, return_inverse=True)
    weights = np.bincount(where, weights, len(values))
    if len(values) <= most:
        return values, weights
    sums = np.cumsum(weights)
    last = np.unique(np.searchsorted(sums, sums[-1] * np.arange(1, most + 1) / most).clip(max=len(values) - 1))
    last[-1] = len(values) - 1
    return values[last], np.diff(sums[last], prepend=0.0)


def _points(n: int, weights: tuple[float, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's values of every feature, with the weights of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0), np.empty(0))] * n
        held: list[tuple[list[np.ndarray], np.ndarray]] = []

        def settle() -> None:
            w = [x for _, x in held]
            for i, (v, u) in enumerate(kept):
                kept[i] = _squeeze(np.concatenate([v, *[c[i] for c, _ in held]]), np.concatenate([u, *w]))
            held.clear()

        for batch in batches:
            held.append((_columns(batch, n), np.asarray(weights)[batch.column(n).to_numpy(zero_copy_only=False)]))
            if sum(len(w) for _, w in held) > GATHERED:
                settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([v for v, _ in kept], pa.list_(pa.float64())), pa.array([u for _, u in kept], pa.list_(pa.float64()))], ["feature", "value", "weight"])

    return run


def edges(values: np.ndarray, weights: np.ndarray, bins: int) -> list[float]:
    """Spark's thresholds of a feature: midpoints of neighbours, where about so many bins of even weight end."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles.tolist()
    stride = float(weights.sum()) / bins
    out, target, sums = [], stride, np.cumsum(weights).tolist()
    for i, middle in enumerate(middles.tolist()):
        if abs(sums[i] - target) < abs(sums[i + 1] - target):
            out.append(middle)
            target += stride
    return out


def _edges(bins: int) -> Callable[[pa.Table], pa.Table]:
    def run(points: pa.Table) -> pa.Table:
        joined = [np.concatenate([np.asarray(x, float) for x in points[c].to_pylist()]) for c in ("value", "weight")]
        return pa.table({"feature": points["feature"][:1], "edges": pa.array([edges(*_squeeze(*joined, most=len(joined[0])), bins)], pa.list_(pa.float64()))})

    return run


def _binned(cuts: list[list[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A byte for each feature of a row, and its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.stack([np.searchsorted(e, c).astype(np.uint8) for e, c in zip(cuts, _columns(batch, len(cuts)), strict=True)], axis=1)
            starts = np.arange(len(cells) + 1, dtype=np.int32) * len(cuts)
            yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(starts), pa.py_buffer(cells.tobytes())]), batch.column(len(cuts))], ["cells", "label"])

    return run


# --- tasks among themselves ----------------------------------------------------


class Peers:
    """The tasks of a barrier stage, each connected with each."""

    def __init__(self, key: bytes):
        context = BarrierTaskContext.get()
        hosts = [x.address.rsplit(":", 1)[0] if x.address.count(":") == 1 else x.address for x in context.getTaskInfos()]
        self.rank, self.n = context.partitionId(), len(hosts)
        self.links: dict[int, Connection] = {}
        with Listener(("0.0.0.0", 0), backlog=self.n, authkey=key) as door:
            ports = [int(p) for p in context.allGather(str(door.address[1]))]
            for i in range(self.rank):
                self._add(i, Client((hosts[i], ports[i]), authkey=key))
                self.links[i].send_bytes(str(self.rank).encode())
            for _ in range(self.rank + 1, self.n):
                link = door.accept()
                self._add(int(link.recv_bytes()), link)

    def _add(self, i: int, link: Connection) -> None:
        with socket.fromfd(link.fileno(), socket.AF_INET, socket.SOCK_STREAM) as s:
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.links[i] = link

    def _partners(self) -> Iterator[int]:
        """Of each round: every task meets every other once, and all pairs of a round are disjoint."""
        odd = self.n - 1 + self.n % 2
        for r in range(odd):
            if self.rank == odd:  # the one that an odd number of the others leaves over
                yield next(i for i in range(odd) if 2 * i % odd == r)
            elif (i := (r - self.rank) % odd) != self.rank:
                yield i
            elif odd < self.n:
                yield odd

    def exchange(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Part i goes to task i; what the others have for this one, by task and flat."""
        got = [parts[self.rank].ravel()] * self.n
        for i in self._partners():
            if self.rank < i:
                self.links[i].send_bytes(parts[i].tobytes())
            got[i] = np.frombuffer(self.links[i].recv_bytes())
            if self.rank > i:
                self.links[i].send_bytes(parts[i].tobytes())
        return got

    def everywhere(self, part: np.ndarray) -> np.ndarray:
        """Every task's part, stacked."""
        return np.stack(self.exchange([part] * self.n)).reshape(self.n, *part.shape)

    def close(self) -> None:
        for link in self.links.values():
            link.close()


# --- learning ------------------------------------------------------------------


def _held(batches: Iterator[pa.RecordBatch], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, rows) of bins, and labels."""
    cells, labels = [np.empty((n, 0), np.uint8)], [np.empty(0, np.int8)]
    for batch in batches:
        column = batch.column(0)
        starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        cells.append(np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]].reshape(-1, n).T.copy())
        labels.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8))
    return np.concatenate(cells, axis=1), np.concatenate(labels)


class Grower:
    """Grows trees over a task's rows, in step with the other tasks."""

    def __init__(self, peers: Peers, cells: np.ndarray, labels: np.ndarray, weights: tuple[float, float], depth: int, least: int, bins: int, share: int, seed: int):
        if cells.shape[1] >= MOST:
            raise ValueError("too many rows in a task: give the session more cores")
        self.peers, self.cells, self.weights = peers, cells, np.asarray(weights)
        self.depth, self.least, self.bins, self.share, self.seed = depth, least, bins, share, seed
        self.w = self.weights[labels]
        self.counted = 1.0 + labels * float(MOST)  # sums tell rows and rows of label 1
        cut = np.linspace(0, len(cells), peers.n + 1).astype(int)
        self.slices = [slice(a, b) for a, b in zip(cut, cut[1:])]
        self.mine = np.arange(len(cells))[self.slices[peers.rank]]

    def _counts(self, rows: np.ndarray | None, at: np.ndarray, n: int, wg: np.ndarray) -> np.ndarray:
        """(count, weight, gradient) by node, own feature and bin, over all tasks' rows; ``at``: the node of each of ``rows``."""
        base, cells = at.astype(np.int64) * self.bins, n * self.bins
        counted, wg = (self.counted, wg) if rows is None else (self.counted[rows], wg[rows])
        out = np.empty((len(self.cells), 3, cells))
        for f, column in enumerate(self.cells):
            index = base + (column if rows is None else column[rows])
            both = np.bincount(index, counted, cells)
            ones = np.floor(both / MOST)
            out[f, 0] = both - ones * MOST
            out[f, 1] = self.weights[0] * (out[f, 0] - ones) + self.weights[1] * ones
            out[f, 2] = np.bincount(index, wg, cells)
        summed = sum(self.peers.exchange([out[s] for s in self.slices]))
        return summed.reshape(len(self.mine), 3, n, self.bins).transpose(1, 2, 0, 3)

    def _best(self, held: np.ndarray, totals: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """(gain, feature, bin, count, weight, gradient on the left) by node; gain 0 where nothing divides it."""
        n = len(totals)
        found = np.zeros((n, 6))
        if len(self.mine) and n:
            left = np.cumsum(held[..., :-1], axis=-1)
            right = totals.T[:, :, None, None] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - (totals[:, 2] ** 2 / totals[:, 1])[:, None, None]
            fits = (left[0] >= self.least) & (right[0] >= self.least) & wanted[:, self.mine, None]
            gain = np.where(fits, gain, 0.0).reshape(n, -1)
            top = gain.argmax(axis=1)
            own, cell = np.divmod(top, self.bins - 1)
            found = np.column_stack([gain[np.arange(n), top], self.mine[own], cell, *left[:, np.arange(n), own, cell]])
        every = self.peers.everywhere(found)
        return every[every[:, :, 0].argmax(axis=0), np.arange(n)]  # of equal ones the first feature's

    def grow(self, g: np.ndarray, number: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The leaf of each row, and the tree's nodes, level by level."""
        rows_n, wg = self.cells.shape[1], self.w * g
        nodes = {k: [] for k in ("n", "weight", "total", "gain", "left", "right", "feature", "bin")}
        # beyond this share of the mean square, a gain is more than rounding
        sums = self.peers.everywhere(np.array([rows_n, self.w.sum(), wg.sum(), (wg * g).sum()])).sum(axis=0)
        totals, noise = sums[None, :3], 1e-13 * sums[3] / sums[1]
        leaf, live, at = np.zeros(rows_n, np.int64), np.arange(rows_n), np.zeros(rows_n, np.int64)
        first, held = 0, None
        for level in range(self.depth + 1):
            n = len(totals)
            best = np.zeros((n, 6))
            if level < self.depth and (may := totals[:, 0] >= 2 * self.least).any():
                if held is None:
                    held = self._counts(None, at, 1, wg)
                else:  # siblings lie side by side; the parents' figures are there
                    small = np.arange(0, n, 2) + (totals[0::2, 0] > totals[1::2, 0])
                    use = may[0::2] | may[1::2]
                    slot = np.full(n, -1)
                    slot[small[use]] = np.arange(use.sum())
                    of = slot[at]
                    part = self._counts(live[of >= 0], of[of >= 0], int(use.sum()), wg)
                    whole, held = held, np.zeros((3, n, len(self.mine), self.bins))
                    held[:, small[use]] = part
                    held[:, (small ^ 1)[use]] = whole[:, use] - part
                order = np.random.default_rng([self.seed, number, level]).random((n, len(self.cells))).argsort(axis=1)
                wanted = np.zeros((n, len(self.cells)), bool)
                np.put_along_axis(wanted, order[:, : self.share], True, axis=1)
                best = self._best(held, totals, wanted)
            gain = best[:, 0] / totals[:, 1]
            splits = gain > noise
            child = np.where(splits, first + n + 2 * (np.cumsum(splits) - 1), -1)
            for k, v in zip(nodes, (totals[:, 0], totals[:, 1], totals[:, 2], np.where(splits, gain, -1.0), child, np.where(splits, child + 1, -1), np.where(splits, best[:, 1], -1), best[:, 2]), strict=True):
                nodes[k].append(v)
            stays = ~splits[at]
            leaf[live[stays]] = first + at[stays]
            if not splits.any():
                break
            live, at = live[~stays], at[~stays]
            right = self.cells[best[at, 1].astype(int), live] > best[at, 2]
            at = 2 * (np.cumsum(splits) - 1)[at] + right
            lefts = best[splits, 3:]
            totals = np.stack([lefts, totals[splits] - lefts], axis=1).reshape(-1, 3)
            held = None if held is None else held[:, splits]
            first += n
        out = {k: np.concatenate(v) for k, v in nodes.items()}
        squares = self.peers.everywhere(np.bincount(leaf, wg * g, len(out["n"]))).sum(axis=0)
        for i in np.flatnonzero(out["left"] >= 0)[::-1]:
            squares[i] = squares[int(out["left"][i])] + squares[int(out["right"][i])]
        return leaf, out | {"squares": squares, "prediction": out["total"] / out["weight"]}


def _learned(cuts: list[list[float]], weights: tuple[float, float], trees: int, rate: float, key: bytes, **settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, labels = _held(batches, len(cuts))
        peers = Peers(key)
        grower = Grower(peers, cells, labels, weights, **settings)
        sign = labels * 2.0 - 1.0
        score, g = np.zeros(len(labels)), sign  # the first tree learns the labels, each later one the rest of the loss
        for number in range(trees):
            leaf, x = grower.grow(g, number)
            score += (rate if number else 1.0) * x["prediction"][leaf]
            g = 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * score, 700.0)))
            if peers.rank == 0:
                n = len(x["n"])
                threshold = [cuts[int(f)][int(b)] if f >= 0 else 0.0 for f, b in zip(x["feature"], x["bin"], strict=True)]
                made = (np.full(n, number), np.arange(n), x["prediction"], np.maximum(0.0, x["squares"] / x["weight"] - x["prediction"] ** 2), x["weight"], x["total"], x["squares"], x["n"].round(), x["gain"], x["left"], x["right"], x["feature"], threshold)
                kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
                names, types = zip(*[c.split() for c in NODES.split(", ")], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(v).astype(kinds[t].to_pandas_dtype())) for v, t in zip(made, types, strict=True)], list(names))
        peers.close()

    return run


# --- the model -------------------------------------------------------------------


def _about(cls: str, uid: str, estimator, version: str, own: bool = True, **more) -> str:
    said = lambda params: {p.name: v for p, v in params.items()}
    return json.dumps({"class": cls, "timestamp": int(time.time() * 1000), "sparkVersion": version, "uid": uid, "paramMap": said(estimator._paramMap) if own else {}, "defaultParamMap": said(estimator._defaultParamMap), **more})


def _loaded(nodes: DataFrame, estimator: GBTClassifier, features: int, path: str) -> GBTClassificationModel:
    """Spark's model of these nodes, by the form in which Spark saves it."""
    spark, n = nodes.sparkSession, estimator.getMaxIter()
    about = _about("org.apache.spark.ml.classification.GBTClassificationModel", estimator.uid, estimator, spark.version, numFeatures=features, numTrees=n)
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    plain = DecisionTreeRegressor()
    trees = [(i, _about("org.apache.spark.ml.regression.DecisionTreeRegressionModel", f"{estimator.uid}_{i}", plain, spark.version, own=False), estimator.getStepSize() if i else 1.0) for i in range(n)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("feature") < 0, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = F.struct("id", "prediction", "impurity", F.array("weight", "total", "squares").alias("impurityStats"), F.col("n").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    nodes.select("treeID", data.alias("nodeData")).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit(rows: DataFrame, names: list[str], weights: tuple[float, float], estimator: GBTClassifier) -> GBTClassificationModel:
    """What ``estimator`` describes, learned from all rows; ``weights``: of a row of label 0 and of label 1."""
    if not any(weights):
        raise ValueError("no rows to learn from")
    spark = rows.sparkSession
    sc, bins, share = spark.sparkContext._jsc.sc(), estimator.getMaxBins(), estimator.getFeatureSubsetStrategy()
    narrow = rows.select(*[F.col(c).cast("double") for c in names], F.col("label").cast("int").alias("label"))
    points = narrow.mapInArrow(_points(len(names), weights), "feature int, value array<double>, weight array<double>")
    found = dict(map(tuple, points.groupBy("feature").applyInArrow(_edges(bins), "feature int, edges array<double>").collect()))
    cuts = [found[i] for i in range(len(names))]
    tasks = sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())
    settings = {"depth": estimator.getMaxDepth(), "least": estimator.getMinInstancesPerNode(), "bins": bins, "share": len(names) if share == "all" else -int(-float(share) * len(names) // 1), "seed": estimator.getSeed()}
    binned = narrow.mapInArrow(_binned(cuts), "cells binary, label int").repartition(tasks)
    nodes = binned.mapInArrow(_learned(cuts, weights, estimator.getMaxIter(), estimator.getStepSize(), secrets.token_bytes(32), **settings), NODES, barrier=True)
    return _loaded(stage.written(nodes, "nodes"), estimator, len(names), stage.place(spark, "trees"))
