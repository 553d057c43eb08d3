"""Ranked search that reads only the document ranges which can hold a result.

An index keeps its postings in blocks as well: one row for each document range and term, with the largest frequency and the
least length in it, bucketed by range. The rows of a range stand in one bucket, so the lists of a query's terms meet
in the task that reads it, and neither bounds nor scores are shuffled below the top k. A range's bound is the sum, over
the terms that it holds, of the most a document of that frequency and length can have; a term that lowers scores adds nothing.

A search reads the heads of its terms' blocks and bounds every range; scores the ranges with the highest bounds, where the
k-th score is a floor for all; and then scores those whose bound reaches that floor. The others are never opened. The
result is that of ``compile.search``, ties included: a bound equal to the floor counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.operators.index import BY_ID, Index
from loomtext.plans.compile import Model, scored_trees, search, statistics, top_k
from loomtext.plans.query import Node, parse, wrap

#: Ranges of each query that are scored first.
FIRST_RANGES = 16
_SLACK = 1e-6  # scores are rounded to six decimals


@dataclass
class Found:
    """Ranked rows, and what finding them took: the floor of each query, the blocks of its terms, and those in ranges that were opened."""

    rows: DataFrame
    floors: dict[str, float] = field(default_factory=dict)
    blocks: int = 0
    opened: int = 0


def terms_of_sum(tree: Node) -> list[Node] | None:
    """The terms of a tree that sums terms, repeats kept; None of any other."""
    args = tree.args if tree.op == "sum" else (tree,)
    inner = [a.args[0] if a.op == "score" else None for a in args]
    return inner if all(i is not None and i.op == "term" for i in inner) else None


def _named(rows: DataFrame, terms: list[Node]) -> Column:
    fields = dict.fromkeys(t.field for t in terms)
    return reduce(lambda a, b: a | b, ((F.col("field") == f) & F.col("term").isin(*dict.fromkeys(t.term for t in terms if t.field == f)) for f in fields))


def _within(ranges) -> Column | None:
    return None if ranges is None else F.col("range").isin(*ranges) if ranges else F.lit(False)


def bounds(index: Index, segment: dict, queries: dict[str, list[Node]], model: Model, counts: dict) -> DataFrame:
    """range, n_blocks and b_<i>: the most that the i-th query can score in each range that holds one of its terms, null in others."""
    place = {t: i for i, t in enumerate(dict.fromkeys(t for ts in queries.values() for t in ts))}

    def most(term: Node) -> Column:
        df, total, docs = (float(counts[c]) for c in (f"df_x{place[term]}", f"sum_{term.field}", f"docs_{term.field}"))
        idf = math.log((counts["num_docs"] - df + 0.5) / (df + 0.5))
        if idf <= 0:
            return F.lit(0.0)
        tf, dl = F.col("most_tf").cast("double"), F.col("least_dl").cast("double")
        return F.lit(idf) * (tf / (tf + F.lit(model.k1) * (F.lit(1.0 - model.b) + F.lit(model.b) * dl / F.lit(total / docs))))

    def of_query(terms: list[Node]) -> Column:
        out = F.lit(None).cast("double")
        for t in dict.fromkeys(terms):
            out = F.when((F.col("field") == t.field) & (F.col("term") == t.term), most(t) * float(terms.count(t))).otherwise(out)
        return out

    heads = index.blocks(segment).filter(_named(index.blocks(segment), list(place))).select("range", "field", "term", "most_tf", "least_dl")
    return heads.groupBy("range").agg(F.count("*").alias("n_blocks"), *(F.sum(of_query(ts)).alias(f"b_{i}") for i, ts in enumerate(queries.values())))


def gathered_in(segment: dict, within: list[int] | DataFrame | None):
    """What brings postings together by document in some ranges of a segment: a list of them, a table, or all."""

    def gather(index: Index, nodes: list[Node]) -> tuple[DataFrame, dict[Node, str]]:
        held = {t: f"t{i}" for i, t in enumerate(dict.fromkeys(nodes))}
        rows = index.blocks(segment)
        rows = rows.filter(_named(rows, list(held)))
        if isinstance(within, DataFrame):
            rows = rows.join(within, "range", "left_semi")
        elif within is not None:
            rows = rows.filter(_within(within))
        each = rows.select("range", "field", "term", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).select("range", "field", "term", F.col("p.docs").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        here = lambda t: (F.col("field") == t.field) & (F.col("term") == t.term)
        fields = dict.fromkeys(t.field for t in held)
        return each.groupBy("range", "doc_id").agg(
            *(F.max(F.when(F.col("field") == f, F.col("dl"))).alias(f"dl_{f}") for f in fields), *(F.max(F.when(here(t), F.col("tf"))).alias(f"tf_{n}") for t, n in held.items())
        ), held

    return gather


def bounded_search(index: Index, queries: dict[str, str], model: Model = Model("bm25"), k: int = 100, report: bool = False) -> Found:
    """The best k of each query. Queries that are not sums of terms under BM25, and indexes without ranges, are searched as ``compile.search`` does.

    report: counts the blocks as well, which takes a pass over their heads.
    """
    trees = {q: parse(wrap(text, model.name), index.stop, index.stem, index.find) for q, text in queries.items()}
    trees = {q: t for q, t in trees.items() if t}
    terms = {q: terms_of_sum(t) for q, t in trees.items()}
    if model.name != "bm25" or not trees or any(t is None for t in terms.values()) or not index.manifest["range_width"]:
        return Found(search(index, queries, model, k))
    place = {t: f"x{i}" for i, t in enumerate(dict.fromkeys(t for ts in terms.values() for t in ts))}
    counts = statistics(index, list(dict.fromkeys(t.field for t in place)), place).first().asDict()  # a number for each term of the queries
    if not counts["num_docs"]:
        return Found(search(index, queries, model, k))

    def known(index: Index, fields: list[str], named: dict[Node, str]) -> DataFrame:
        of_terms = {f"{c}_{name}": counts[f"{c}_{place[t]}"] for t, name in named.items() for c in ("df", "ctf")}
        row = {"num_docs": counts["num_docs"]} | {f"{c}_{f}": counts[f"{c}_{f}"] for f in fields for c in ("sum", "docs")} | of_terms
        return index.spark.range(1, numPartitions=1).select(*(F.lit(v).cast("long").alias(c) for c, v in row.items()))

    each = {s["name"]: bounds(index, s, terms, model, counts) for s in index.segments}
    scored_in = lambda s, within: top_k(scored_trees(index, trees, model, gather=gathered_in(s, within), count=known), k)
    first = {}
    for s in index.segments:
        long = each[s["name"]].select("range", F.posexplode(F.array(*(f"b_{i}" for i in range(len(terms))))).alias("q", "b")).filter("b is not null")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("b"), "range"))
        first[s["name"]] = sorted({r[0] for r in long.withColumn("rank", rank).filter(F.col("rank") <= FIRST_RANGES).select("range").collect()})
    early = top_k(reduce(DataFrame.unionByName, (scored_in(s, first[s["name"]]).drop("rank") for s in index.segments)), k)
    found = Found(early, dict(early.filter(F.col("rank") == k).select("qid", "score").collect()))
    results = []
    for s in index.segments:
        own = each[s["name"]]
        reached = reduce(lambda a, b: a | b, (F.col(f"b_{i}") >= F.lit(found.floors.get(q, -math.inf) - _SLACK) for i, q in enumerate(terms)))
        if report:
            n, opened = own.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)), F.coalesce(F.sum(F.when(reached, F.col("n_blocks"))), F.lit(0))).first()
            found.blocks, found.opened = found.blocks + n, found.opened + opened
        wanted = own.filter(reached).select("range")
        few = [r[0] for r in wanted.limit(BY_ID + 1).collect()]
        results.append(scored_in(s, sorted(few) if len(few) <= BY_ID else wanted))
    found.rows = results[0] if len(results) == 1 else top_k(reduce(DataFrame.unionByName, (r.drop("rank") for r in results)), k)
    return found
