"""A linear ranking machine that never forms pairs.

It minimises |w|^2 / 2 + cost / queries * the sum over pairs (a document of higher relevance and one of lower, of one query) of
max(0, 1 - w.(x_high - x_low)), by cutting planes. A plane needs the pairs that the present weights violate, and of
those only how often each document stands in them: with scores in order, that is a running count per level of relevance
up to one margin away, so a round sorts each query's rows and sums once, in n log n. What reaches the driver is a
number for each feature and round; the small quadratic program over the planes is solved there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.storage import discard, settle

ROUNDS = 200
#: Most levels of relevance, each of which is a running count.
MOST_LEVELS = 64


def _score(weights, columns: tuple[str, ...]) -> Column:
    out = F.lit(0.0)
    for w, c in zip(weights, columns):
        out = out + F.lit(float(w)) * F.col(c)
    return out


def pair_counts(scored: DataFrame, levels: list[int]) -> DataFrame:
    """scored (qid, rel, s and others) with n_over and n_under: the lower ranked documents that a row does not beat by 1, and the higher ones that do not beat it by 1."""
    reach = lambda order: Window.partitionBy("qid").orderBy(order).rangeBetween(Window.unboundedPreceding, 1)
    over, under = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in levels:
        of_level = F.when(F.col("rel") == level, 1)
        over = over + F.when(F.col("rel") > level, F.count(of_level).over(reach(F.desc("s")))).otherwise(0)
        under = under + F.when(F.col("rel") < level, F.count(of_level).over(reach(F.asc("s")))).otherwise(0)
    return scored.withColumn("n_over", over).withColumn("n_under", under)


def plane(rows: DataFrame, columns: tuple[str, ...], weights: np.ndarray, levels: list[int]) -> tuple[int, np.ndarray]:
    """How many pairs the weights violate, and the sum of their differences of features, by one aggregation."""
    counted = pair_counts(rows.withColumn("s", _score(weights, columns)), levels)
    net = (F.col("n_over") - F.col("n_under")).cast("double")
    n, *sums = counted.agg(F.coalesce(F.sum("n_over"), F.lit(0)), *(F.coalesce(F.sum(net * F.col(c)), F.lit(0.0)) for c in columns)).first()
    return int(n), np.array(sums, dtype=float)


def solved(offsets: list[float], slopes: list[np.ndarray], cost: float) -> tuple[np.ndarray, float]:
    """Weights and slack of: least |w|^2 / 2 + cost * slack with slack >= 0 and slack >= offset - w.slope for every plane.

    Its dual gives each plane a share of ``cost``, the rest being idle; a step moves share between the two planes that gain the most.
    """
    b, g = np.append(offsets, 0.0), np.vstack([*slopes, np.zeros_like(slopes[0])])
    share = np.zeros(len(b))
    share[-1] = cost
    w = np.zeros(g.shape[1])
    for _ in range(200_000):
        gain = b - g @ w
        up, down = int(np.argmax(gain)), int(np.argmin(np.where(share > 0, gain, np.inf)))
        if gain[up] - gain[down] < 1e-12:
            break
        apart = g[up] - g[down]
        size = float(apart @ apart)
        step = share[down] if size == 0 else min(share[down], (gain[up] - gain[down]) / size)
        share[up] += step
        share[down] -= step
        w = w + step * apart
    return w, float(max(0.0, (b - g @ w).max()))


@dataclass(frozen=True)
class Ranker:
    """Weights of features by name."""

    columns: tuple[str, ...]
    weights: tuple[float, ...]
    rounds: int = 0

    def rank(self, features: DataFrame) -> DataFrame:
        """qid, doc_id, score, new_rank of features (qid, doc_id, rank, ...): by score, ties by the rank before, then by id."""
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "doc_id"))
        scored = features.withColumn("score", F.round(_score(self.weights, self.columns), 6))
        return scored.select("qid", "doc_id", "score", place.cast("long").alias("new_rank"))


def train(features: DataFrame, relevance: Column, columns: tuple[str, ...], cost: float = 0.001, tolerance: float = 1e-4) -> Ranker:
    """The machine of some features (qid and columns). Rows of null relevance are left out; without pairs all weights are 0."""
    rows = settle(features.select("qid", relevance.cast("int").alias("rel"), *(F.col(c).cast("double").alias(c) for c in columns)).filter("rel is not null"), "rank-features")
    levels = sorted(r[0] for r in rows.select("rel").distinct().limit(MOST_LEVELS + 1).collect())
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"relevance has over {MOST_LEVELS} levels")
    n_queries = max(1, rows.select("qid").distinct().count())
    weights, slack, offsets, slopes = np.zeros(len(columns)), 0.0, [], []
    for _ in range(ROUNDS):
        n, sums = plane(rows, columns, weights, levels)
        offset, slope = n / n_queries, sums / n_queries
        if offset - weights @ slope - slack <= tolerance * max(1.0, slack):
            break
        offsets.append(offset)
        slopes.append(slope)
        weights, slack = solved(offsets, slopes, cost)
    discard(rows)
    return Ranker(tuple(columns), tuple(float(w) for w in weights), len(offsets))
