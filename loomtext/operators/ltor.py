"""Features for learning to rank: eighteen per (query, document), from the postings of the queries' terms and the stored lengths of the candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import text as T
from loomtext.operators import ranksvm
from loomtext.operators.index import Index
from loomtext.operators.ranksvm import Ranker
from loomtext.plans.compile import Model, gathered, search, statistics
from loomtext.plans.query import Node
from loomtext.storage import settle

FIELDS = ("body", "title", "url", "inlink")
#: Candidates of a batch that are broadcast; those of larger batches are joined by shuffle.
BROADCAST_ROWS = 100_000
FEATURES = tuple(f"f{i}" for i in range(1, 19))


def raw_features(index: Index, queries: dict[str, list[str]], spam: Column, page_rank: Column, url: Column, k: int = 100, bm25: Model = Model("bm25"), indri: Model = Model("indri")) -> DataFrame:
    """qid, doc_id, f1..f18 of each query's best k documents by BM25 on body. A feature of an empty field is null.

    queries: the analysed terms of each, repeats kept. spam, page_rank and url are expressions over the stored columns. f1 spam score, f2 url depth, f3 Wikipedia, f4 page rank; then
    BM25, Indri and overlap for body, title, url, inlink; f17 a cosine-like share of body; f18 repeats f15.
    """
    terms = sorted({t for ts in queries.values() for t in ts})
    place = {t: i for i, t in enumerate(terms)}
    node = {(f, t): Node("term", term=t, field=f) for f in FIELDS for t in terms}
    best = search(index, {q: " ".join(ts) for q, ts in queries.items()}, bm25, k).select("qid", "doc_id", "rank")
    best = settle(best, "candidates")  # k rows a query at most, read twice
    few = F.broadcast if k * len(queries) <= BROADCAST_ROWS else (lambda rows: rows)
    ids = index.ids_of(best)
    docs = index.documents_of(best, ids)
    own = docs.select("doc_id", spam.cast("double").alias("f1"), T.url_depth(url).cast("double").alias("f2"), T.is_wikipedia(url).cast("double").alias("f3"), F.coalesce(page_rank, F.lit(0.0)).alias("f4"), F.col("sq_body").alias("squares"), *(F.col(f"dl_{f}").cast("double").alias(f"dl_{f}") for f in FIELDS))
    found, held = gathered(index, list(node.values()), lambda lists: index.of_documents(lists, best, ids))
    counts = found.select("doc_id", *(F.col(f"tf_{held[n]}").cast("double").alias(f"tf_{f}_{place[t]}") for (f, t), n in node.items()))
    names = [f"tf_{f}_{i}" for f in FIELDS for i in place.values()]
    stats = statistics(index, list(FIELDS), {n: f"{f}_{place[t]}" for (f, t), n in node.items()})
    stats = stats.select(*(F.col(c).cast("double").alias(c) for c in stats.columns))
    rows = own.join(counts, "doc_id", "left").fillna(0.0, names).crossJoin(F.broadcast(stats))

    def of_query(qid: str, words: list[str]) -> Column:
        n, found = float(len(words)), {}
        for j, f in enumerate(FIELDS):
            dl, total, there = F.col(f"dl_{f}"), F.col(f"sum_{f}"), F.col(f"dl_{f}") > 0
            score, log, zero, matched = F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(0.0)
            for i in (place[w] for w in words):
                tf, df, ctf = F.col(f"tf_{f}_{i}"), F.col(f"df_{f}_{i}"), F.col(f"ctf_{f}_{i}")
                idf = F.ln((F.col("num_docs") - df + F.lit(0.5)) / (df + F.lit(0.5)))
                average = total / F.col(f"docs_{f}")
                score = score + F.when(tf > 0, idf * tf / (tf + F.lit(bm25.k1) * (F.lit(1 - bm25.b) + F.lit(bm25.b) * dl / average))).otherwise(F.lit(0.0))
                p = F.when(total > 0, ctf / total).otherwise(F.lit(0.0))
                s = F.lit(1 - indri.lam) * (tf + F.lit(indri.mu) * p) / (dl + F.lit(indri.mu)) + F.lit(indri.lam) * p
                zero, log = zero | (s <= 0), log + F.ln(F.greatest(s, F.lit(5e-324)))
                matched = matched + (tf > 0).cast("double")
            found[f"f{5 + 3 * j}"] = F.when(there, score)
            found[f"f{6 + 3 * j}"] = F.when(there, F.when(zero | (matched == 0), F.lit(0.0)).otherwise(F.exp(log / F.lit(n))))
            found[f"f{7 + 3 * j}"] = F.when(there, matched / F.lit(n))
        sums = F.lit(0.0)
        for i in (place[w] for w in words):
            sums = sums + F.col(f"tf_body_{i}")
        found["f17"] = F.when(F.col("dl_body") > 0, sums / (F.sqrt(F.lit(n)) * F.sqrt("squares")))
        found["f18"] = found["f15"]
        match = F.lit(False)
        for i in (place[w] for w in words):
            match = match | (F.col(f"tf_body_{i}") > 0)
        return F.when(match, F.struct(F.lit(qid).alias("qid"), *(found[x].alias(x) for x in FEATURES[4:])))

    every = rows.select("doc_id", "f1", "f2", "f3", "f4", F.explode(F.filter(F.array(*(of_query(q, ws) for q, ws in queries.items())), lambda r: r.isNotNull())).alias("r"))
    return every.select("r.qid", "doc_id", "f1", "f2", "f3", "f4", *(f"r.{x}" for x in FEATURES[4:])).join(few(best), ["qid", "doc_id"])


def scaled(features: DataFrame, disabled: tuple[int, ...] = (), least_max: float | None = None) -> DataFrame:
    """Each feature within its query to [0, 1]; null and constant features are 0, disabled ones leave.

    ``least_max`` (0.0) keeps the largest value of a feature from being negative, as an engine whose maximum starts at zero has it.
    """
    w = Window.partitionBy("qid")
    cols = [f for f in FEATURES if int(f[1:]) not in disabled and f in features.columns]
    low = lambda f: F.min(f).over(w)
    high = lambda f: F.max(f).over(w) if least_max is None else F.greatest(F.max(f).over(w), F.lit(least_max))
    scale = lambda f: F.coalesce(F.when(high(f) > low(f), (F.col(f) - low(f)) / (high(f) - low(f))), F.lit(0.0)).alias(f)
    return features.select("qid", "doc_id", "rank", *(scale(f) for f in cols))


def svm_light(features: DataFrame, relevance: Column) -> DataFrame:
    """Lines ``rel qid:Q j:value ... # id``."""
    cols = [f for f in FEATURES if f in features.columns]
    values = F.concat_ws(" ", *(F.format_string(f"{f[1:]}:%.12f", F.col(f)) for f in cols))
    return features.select("qid", "doc_id", F.concat(relevance.cast("int").cast("string"), F.lit(" qid:"), F.col("qid"), F.lit(" "), values, F.lit(" # "), F.col("doc_id").cast("string")).alias("line"))


def train(features: DataFrame, relevance: Column, cost: float = 0.001) -> Ranker:
    """A linear ranker of the features that are there."""
    return ranksvm.train(features, relevance, tuple(f for f in FEATURES if f in features.columns), cost)


def rerank(features: DataFrame, relevance: Column, cost: float = 0.001, tests: DataFrame | None = None) -> DataFrame:
    """Trains a ranker on some queries' features and ranks those of ``tests``, queries of their own, or the same: qid, doc_id, score, new_rank."""
    return train(features, relevance, cost).rank(features if tests is None else tests)
