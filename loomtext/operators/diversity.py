"""Result diversification: candidates with one score per intent, and two greedy rerankings per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_RESULT = "qid string, doc_id long, score double, rank long"


def candidates(runs: DataFrame, depth: int = 100) -> DataFrame:
    """qid, doc_id, rank, original, intents (array) from a run with rows of ``q`` and of its intents ``q.k``.

    Runs (qid, doc_id, score, rank) are cut at ``depth``. The documents are those of the original run; an intent
    that does not hold one scores 0.
    """
    cut = runs.filter(F.col("rank") <= depth)
    dotted = F.instr("qid", ".") > 0
    original = cut.filter(~dotted).select("qid", "doc_id", "rank", F.col("score").alias("original"))
    intents = cut.filter(dotted).select(F.substring_index("qid", ".", 1).alias("qid"), F.col("qid").alias("intent"), "doc_id", "score")
    known = intents.groupBy("qid").agg(F.array_sort(F.collect_set("intent")).alias("known"))
    per = intents.groupBy("qid", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("intent", "score"))).alias("by"))
    joined = original.join(known, "qid").join(per, ["qid", "doc_id"], "left")
    return joined.select("qid", "doc_id", "rank", "original", F.transform("known", lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0.0))).alias("intents"))


def normalised(found: DataFrame, only_if_above_one: bool = False) -> DataFrame:
    """All scores of a query divided by the largest of the column sums; optionally only where some score is 1 or more."""
    w = Window.partitionBy("qid")
    sums = F.array(F.sum("original").over(w))
    long = found.select("qid", F.posexplode("intents").alias("i", "s")).groupBy("qid", "i").agg(F.sum("s").alias("s")).groupBy("qid").agg(F.max("s").alias("most"))
    joined = found.join(long, "qid", "left").withColumn("most", F.greatest(F.array_max(sums), F.coalesce("most", F.lit(0.0))))
    high = F.max(F.greatest("original", F.array_max("intents"))).over(w)
    by = F.when(F.col("most") == 0, F.lit(1.0)).otherwise(F.col("most"))
    if only_if_above_one:
        by = F.when(high >= 1, by).otherwise(F.lit(1.0))
    scaled = joined.withColumn("by", by)
    return scaled.select("qid", "doc_id", "rank", (F.col("original") / F.col("by")).alias("original"), F.transform("intents", lambda s: s / F.col("by")).alias("intents"))


def _ordered(qids, docs, picked):
    import pandas as pd

    order = sorted(range(len(picked)), key=lambda i: -picked[i][1])
    return pd.DataFrame({"qid": [qids] * len(order), "doc_id": [docs[picked[i][0]] for i in order], "score": [picked[i][1] for i in order], "rank": range(1, len(order) + 1)})


def xquad(found: DataFrame, lam: float, results: int = 100) -> DataFrame:
    """Greedy: (1 - lam) P(d|q) + lam * mean over intents of P(d|q_i) times what the chosen leave uncovered."""

    def one(key, rows):
        import numpy as np

        rows = rows.sort_values("rank")
        base, by = rows["original"].to_numpy(), np.array(rows["intents"].tolist(), dtype=float)
        left, open_, picked = np.ones(by.shape[1]), np.ones(len(base), dtype=bool), []
        while open_.any() and len(picked) < results:
            score = np.where(open_, (1 - lam) * base + lam * (by * left).mean(axis=1), -np.inf)
            best = int(score.argmax())
            picked.append((best, float(score[best])))
            left, open_[best] = left * (1 - by[best]), False
        return _ordered(key[0], rows["doc_id"].to_numpy(), picked)

    return found.groupBy("qid").applyInPandas(one, _RESULT)


def pm2(found: DataFrame, lam: float, results: int = 100) -> DataFrame:
    """Greedy seats: the intent with the largest quotient leads; a pick takes seats in proportion to its intents."""

    def one(key, rows):
        import numpy as np

        rows = rows.sort_values("rank")
        by = np.array(rows["intents"].tolist(), dtype=float)
        m = by.shape[1]
        share, seats, open_, picked = results / m, np.zeros(m), np.ones(len(by), dtype=bool), []
        while open_.any() and len(picked) < results:
            quotient = share / (2 * seats + 1)
            lead = int(quotient.argmax())
            weighed = by * quotient
            score = np.where(open_, lam * weighed[:, lead] + (1 - lam) * (weighed.sum(axis=1) - weighed[:, lead]), -np.inf)
            best = int(score.argmax())
            picked.append((best, float(score[best])))
            open_[best] = False
            if by[best].sum() > 0:
                seats = seats + by[best] / by[best].sum()
        return _ordered(key[0], rows["doc_id"].to_numpy(), picked)

    return found.groupBy("qid").applyInPandas(one, _RESULT)


ALGORITHMS = {"xquad": xquad, "pm2": pm2}


def rerank(found: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """Reranks by ``diversity:algorithm``, ``diversity:lambda`` (0) and ``diversity:maxResultRankingLength`` (100).

    A missing or unknown algorithm raises.
    """
    name = parameters.get("diversity:algorithm", "").lower().replace("-", "")
    if name not in ALGORITHMS:
        raise ValueError(f"no diversification algorithm named {name or 'nothing'}")
    return ALGORITHMS[name](found, float(parameters.get("diversity:lambda", 0)), int(parameters.get("diversity:maxResultRankingLength", 100)))


def ndcg(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """qid, ndcg over the first k of results (qid, doc_id, rank); qrels: qid, doc_id, rel."""
    gain = lambda rel, at: (F.pow(F.lit(2.0), rel) - 1) / F.log2(at + F.lit(1.0))
    got = results.filter(F.col("rank") <= k).join(qrels, ["qid", "doc_id"], "left").groupBy("qid").agg(F.sum(gain(F.coalesce("rel", F.lit(0)), F.col("rank"))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id"))
    ideal = qrels.withColumn("at", place).filter(F.col("at") <= k).groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("at"))).alias("best"))
    return got.join(ideal, "qid", "left").select("qid", F.round(F.coalesce(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")), F.lit(0.0)), 6).alias("ndcg"))


def intent_precision(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """qid, ia_precision: precision at k, averaged over intents; qrels: qid, intent, doc_id, rel."""
    intents = qrels.select("qid", "intent").distinct()
    first = results.filter(F.col("rank") <= k).select("qid", "doc_id")
    hits = first.join(qrels.filter("rel > 0"), ["qid", "doc_id"]).groupBy("qid", "intent").agg(F.count("*").alias("n"))
    each = intents.join(hits, ["qid", "intent"], "left").withColumn("p", F.coalesce("n", F.lit(0)) / F.lit(float(k)))
    return each.groupBy("qid").agg(F.round(F.avg("p"), 6).alias("ia_precision"))
