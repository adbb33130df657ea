"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a sample of at most ``sample`` vectors (those with the
smallest hash of their id): a node splits at the median of a random direction
until it holds at most ``leaf`` sample vectors. The forest (at most
``trees * 2 * sample / leaf`` directions) goes to all tasks; every vector of the
table is indexed in its leaf of each tree.

A query walks all trees with one priority queue: the entry with the smallest
distance to the split planes on its way is taken next, whichever tree it is in,
until ``probes`` leaves are reached. The members of these leaves are compared
with the query exactly, in double precision, and the best are merged.

Equal vectors are indexed once, as a class with its ``k + 1`` smallest ids (no
query can return more of them), and equal queries are searched once, so a vector
that a third of all rows share costs no more than another. Leaves are dealt out
in parts of at most ``part`` members times ``part`` queries.

Edge cases: vectors that are null or zero, hold null or non-finite components, or
whose length is not that of most sample vectors take no part, neither as
queries nor as candidates; so do rows with a null id; a query returns fewer
rows if there are fewer candidates; of a repeated id and vector one row counts;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Forest:
    """Trees as flat arrays: direction and threshold of inner nodes, children (leaves as -1 - number)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.directions, self.thresholds, self.children, self.roots = [], [], [], []
        self.leaves = 0
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng))
        dim = sample.shape[1]
        self.directions = np.array(self.directions).reshape(-1, dim)
        self.thresholds = np.array(self.thresholds)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng) -> int:
        if len(rows) > leaf:
            direction = rng.standard_normal(x.shape[1])
            direction /= np.linalg.norm(direction)
            side = x[rows] @ direction
            cut = float(np.median(side))
            left, right = rows[side < cut], rows[side >= cut]
            if len(left) and len(right):
                node = len(self.children)
                self.directions.append(direction)
                self.thresholds.append(cut)
                self.children.append((0, 0))
                self.children[node] = (self._grow(x, left, leaf, rng), self._grow(x, right, leaf, rng))
                return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector (row) in each tree (column)."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            on = np.flatnonzero(at >= 0)
            while len(on):
                node = at[on]
                right = np.einsum("ij,ij->i", x[on], self.directions[node]) >= self.thresholds[node]
                at[on] = self.children[node, right.astype(np.int64)]
                on = on[at[on] >= 0]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, probes: int) -> list[int]:
        """Leaves of all trees in the order of the shared queue."""
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < probes:
            far, node = heapq.heappop(queue)
            while node >= 0:
                side = float(self.directions[node] @ q) - self.thresholds[node]
                near = 1 if side >= 0 else 0
                heapq.heappush(queue, (max(far, abs(side)), int(self.children[node, 1 - near])))
                node = int(self.children[node, near])
            found.append(-1 - node)
        return found


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - q) ** 2).sum(axis=1))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def nearest(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100,
            trees: int = 16, leaf: int = 128, probes: int = 200, sample: int = 20_000, part: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row whose id ``every`` divides."""
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by ``sample``
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not picked:
        return empty
    dim = Counter(len(r.v) for r in picked).most_common(1)[0][0]
    forest = Forest(np.unique(np.array([r.v for r in picked if len(r.v) == dim]), axis=0), trees, leaf)
    rows = rows.filter(F.size("v") == dim).distinct()

    first = Window.partitionBy("v").orderBy("id")
    classes = (rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
               .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("c"), "v", "ids"))
    asked = rows.filter(F.col("id") % every == 0)
    questions = asked.groupBy("v").agg(F.min("id").alias("q"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = forest.leaf_of(_matrix(batch.column("v"), dim))
                who = np.repeat(np.arange(batch.num_rows), trees)
                yield pa.record_batch([pa.array(at.ravel()), batch.column("c").take(pa.array(who)), batch.column("v").take(pa.array(who))],
                                      names=["leaf", "c", "v"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = [forest.search(q, probes) for q in _matrix(batch.column("v"), dim)]
                who = np.repeat(np.arange(batch.num_rows), [len(x) for x in at])
                yield pa.record_batch([pa.array([x for row in at for x in row], pa.int64()), batch.column("q").take(pa.array(who)),
                                       batch.column("v").take(pa.array(who))], names=["leaf", "q", "v"])

    members = classes.mapInArrow(index, f"leaf long, c long, v {kind}")
    visits = questions.mapInArrow(walk, f"leaf long, q long, v {kind}")

    def split(side: DataFrame, own: str, other: str, who: str) -> DataFrame:
        """A leaf's rows in their own part, once for every part of the other side."""
        return (side.join(F.broadcast(parts), "leaf")  # one row for each leaf of the forest
                .withColumn(own, F.pmod(F.xxhash64(who), F.col(f"n_{own}")))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)))
                .select("leaf", "m", "s", who, "v"))

    def of(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("leaf").agg(F.ceil(F.count("*") / part).alias(name))

    parts = of(members, "n_m").join(of(visits, "n_s"), "leaf")
    left, right = split(members, "m", "s", "c"), split(visits, "s", "m", "q")

    def compare(m: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(m) and len(s):
            x, c = np.stack(m.v.to_numpy()).astype(np.float64), m.c.to_numpy()
            for q, v in zip(s.q.tolist(), s.v):
                score = distances(x, np.asarray(v, np.float64))
                best = np.lexsort((c, score))[:k + 1]
                out.append(pd.DataFrame({"q": q, "c": c[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "c": [], "score": []})

    key = ("leaf", "m", "s")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "q long, c long, score double")
    best = Window.partitionBy("q").orderBy("score", "c")
    kept = found.groupBy("q", "c").agg(F.min("score").alias("score")).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    answers = kept.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    # the answers of a question hold at most (k + 1) * (k + 1) ids; each of its copies leaves out itself
    top = Window.partitionBy("q").orderBy("score", "vec_id")
    answers = answers.withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= k + 1)
    lists = answers.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    same = asked.join(questions, "v").select(F.col("id").alias("query_id"), "q").join(lists, "q")
    return same.select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
