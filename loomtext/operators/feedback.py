"""Query expansion from the best documents of a first pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.index import BY_ID, Index
from loomtext.plans.compile import Model, scored_trees, search, top_k
from loomtext.plans.query import Node, parse, wrap


def expansion_terms(index: Index, best: DataFrame, terms: int = 20, mu: float = 0.0) -> DataFrame:
    """qid, term, weight: every term t of the feedback documents d (best: qid, doc_id, score) by
    the sum of (tf + mu p) / (len + mu) * score * ln(1 / p), p being t's share of the collection.
    """
    best = best.select("qid", "doc_id", "score")
    few = best.limit(BY_ID + 1).collect()
    ids = None
    if len(few) <= BY_ID:
        best, ids = index.spark.createDataFrame(few, best.schema), sorted({r["doc_id"] for r in few})
    docs = best.join(index.documents_of(best, ids).select("doc_id", F.col("dl_body").alias("len")), "doc_id")
    vectors = index.term_vectors(ids) if ids else index.of_documents(index.term_vectors(), best, ids)
    tf = vectors.join(best.select("qid", "doc_id"), "doc_id").filter(~F.col("term").rlike("[.,]")).select("qid", "doc_id", "term", "tf")
    pairs = tf.select("qid", "term").distinct().join(docs, "qid").join(tf, ["qid", "doc_id", "term"], "left")
    named = [r[0] for r in tf.select("term").distinct().limit(BY_ID + 1).collect()] if ids is not None else []
    ctf = index.dictionary(terms=sorted(named)) if 0 < len(named) <= BY_ID else index.dictionary().join(tf.select("term").distinct(), "term", "left_semi")
    ctf = ctf.select("term", "ctf")
    total = index.table("fields").filter(F.col("field") == "body").select(F.col("sum_tf").cast("double").alias("c"))
    p = F.col("ctf").cast("double") / F.col("c")
    weight = (F.coalesce("tf", F.lit(0)) + F.lit(mu) * p) / (F.col("len") + F.lit(mu)) * F.col("score") * F.ln(F.lit(1.0) / p)
    weighed = pairs.join(ctf, "term").crossJoin(F.broadcast(total)).groupBy("qid", "term").agg(F.round(F.sum(weight), 8).alias("weight"))
    ranked = top_k(weighed.select("qid", F.col("term").alias("doc_id"), F.col("weight").alias("score")), terms, 8)
    return ranked.select("qid", F.col("doc_id").alias("term"), F.col("score").alias("weight"), "rank")


def expansion_query(expanded: DataFrame) -> DataFrame:
    """qid, query: the expansion as a weighted query, weights with four decimals."""
    part = F.struct("rank", F.format_string("%.4f %s", F.col("weight"), F.col("term")).alias("text"))
    parts = F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"])
    return expanded.groupBy("qid").agg(F.concat(F.lit("#WAND( "), F.array_join(parts, " "), F.lit(" )")).alias("query"))


def expanded_search(index: Index, queries: dict[str, str], model: Model, docs: int = 10, terms: int = 20, mu: float = 0.0, original: float = 0.6, k: int = 100) -> DataFrame:
    """Results of #wand(w original (1 - w) expansion). The expansion's few terms pass through the driver, as they make the plan."""
    if model.name != "indri":
        raise ValueError("feedback needs the Indri model")
    found: dict[str, list[tuple[float, str]]] = {}
    for r in expansion_terms(index, search(index, queries, model, docs), terms, mu).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append((round(r["weight"], 4), r["term"]))
    trees = {}
    for qid, text in queries.items():
        tree = parse(wrap(text, "indri"), index.stop, index.stem, index.find)
        more = found.get(qid)
        if more:
            expansion = Node("wand", tuple(Node("score", (Node("term", term=t),)) for _, t in more), tuple(w for w, _ in more))
            tree = Node("wand", (tree, expansion), (original, 1 - original))
        trees[qid] = tree
    return top_k(scored_trees(index, {q: t for q, t in trees.items() if t}, model), k)
