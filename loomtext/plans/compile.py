"""Query trees as Column expressions over one row per matching document, and ranked results as DataFrames.

The postings of a batch's terms, and no others, are read from the index and brought together by document, positions
only where a node asks for proximity. df and ctf of terms come from the dictionary, those of other positional nodes
from the same rows; with the field statistics they are a single row that joins every document, where scores are plain
expressions. What moves is the postings of the query's terms and the best k rows of each task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.operators import proximity
from loomtext.operators.index import Index
from loomtext.plans.query import Node, field_of, parse, wrap


@dataclass(frozen=True)
class Model:
    """name: unranked, ranked, bm25 or indri. Parameters are doubles."""

    name: str
    k1: float = 1.2
    b: float = 0.75
    k3: float = 0.0
    mu: float = 2500.0
    lam: float = 0.4


class UnsupportedOperator(ValueError):
    pass


class _Plan:
    """Collects the positional nodes of some trees and names their columns."""

    def __init__(self, trees: list[Node]):
        self.nodes: dict[Node, str] = {}
        self.fields: list[str] = []
        for tree in trees:
            self._visit(tree)

    def _visit(self, node: Node) -> None:
        if node.op == "score":
            inner = node.args[0]
            self.nodes.setdefault(inner, f"p{len(self.nodes)}")
            if field_of(inner) not in self.fields:
                self.fields.append(field_of(inner))
        else:
            for a in node.args:
                self._visit(a)


def terms_of(node: Node) -> list[Node]:
    """The terms of a positional node."""
    return [node] if node.op == "term" else [t for a in node.args for t in terms_of(a)]


def positions_of(node: Node, held: dict[Node, str]) -> Column:
    """The positions of a positional node, over columns pos_<name> of its terms; a term that is not there has none."""
    if node.op == "term":
        return F.coalesce(F.col(f"pos_{held[node]}"), F.array().cast("array<int>"))
    args = [positions_of(a, held) for a in node.args]
    if node.op == "syn":
        return proximity.synonyms(args)
    return proximity.near(args, node.distance) if node.op == "near" else proximity.within(args, node.distance)


def frequency_of(node: Node, held: dict[Node, str]) -> Column:
    """How often a positional node stands in a document, over columns tf_<name> of terms and pos_<name> where places count."""
    if node.op == "term":
        return F.coalesce(F.col(f"tf_{held[node]}"), F.lit(0).cast("long"))
    if _counted(node):
        return sum((frequency_of(a, held) for a in node.args[1:]), frequency_of(node.args[0], held))
    return F.size(positions_of(node, held)).cast("long")


def _counted(node: Node) -> bool:
    """Whether frequencies of its terms are enough for a node."""
    return node.op == "term" or node.op == "syn" and all(a.op == "term" for a in node.args)


def gathered(index: Index, nodes: list[Node], only=lambda rows: rows) -> tuple[DataFrame, dict[Node, str]]:
    """One row per document that holds a term of the nodes: doc_id, dl_<field> where it does, tf_<name>, pos_<name>; and the terms' names.

    only: takes what is wanted of the postings before they meet.
    """
    placed = list(dict.fromkeys(t for n in nodes if not _counted(n) for t in terms_of(n)))
    held = {t: f"t{i}" for i, t in enumerate(dict.fromkeys(t for n in nodes for t in terms_of(n)))}
    fields = list(dict.fromkeys(t.field for t in held))
    columns = ("term", "doc_id", "tf", "dl", *(("positions",) if placed else ()))
    rows = None
    for f in fields:
        own = only(index.postings([t.term for t in held if t.field == f], f, columns)).withColumn("of", F.lit(f))
        rows = own if rows is None else rows.unionByName(own)
    here = lambda t: (F.col("of") == t.field) & (F.col("term") == t.term)
    return rows.groupBy("doc_id").agg(
        *(F.max(F.when(F.col("of") == f, F.col("dl"))).alias(f"dl_{f}") for f in fields), *(F.max(F.when(here(t), F.col("tf"))).alias(f"tf_{n}") for t, n in held.items()),
        *(F.max(F.when(here(t), F.col("positions"))).alias(f"pos_{held[t]}") for t in placed),
    ), held


def statistics(index: Index, fields: list[str], terms: dict[Node, str]) -> DataFrame:
    """One row: num_docs, sum_<field>, docs_<field>, and df_<name>, ctf_<name> of terms."""
    of = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    whole = index.table("fields").agg(F.max("num_docs").alias("num_docs"), *(of(f, "sum_tf").alias(f"sum_{f}") for f in fields), *(of(f, "doc_count").alias(f"docs_{f}") for f in fields))
    for f in dict.fromkeys(t.field for t in terms):
        own = {t: n for t, n in terms.items() if t.field == f}
        count = lambda t, c: F.coalesce(F.max(F.when(F.col("term") == t.term, F.col(c))), F.lit(0).cast("long"))
        some = index.dictionary(f, [t.term for t in own]).agg(*(count(t, "df").alias(f"df_{n}") for t, n in own.items()), *(count(t, "ctf").alias(f"ctf_{n}") for t, n in own.items()))
        whole = whole.crossJoin(F.broadcast(some))  # a row each
    return whole


def positional(index: Index, node: Node) -> DataFrame:
    """doc_id, tf, positions of a positional node."""
    rows, held = gathered(index, [Node("near", (node,))])  # any node that asks for places
    return rows.select("doc_id", positions_of(node, held).alias("positions")).filter(F.size("positions") > 0).select("doc_id", F.size("positions").cast("long").alias("tf"), "positions")


class _Scores:
    """match, score and default score of a tree, over columns of frequencies and statistics."""

    def __init__(self, plan: _Plan, model: Model):
        self.plan, self.model = plan, model

    def of(self, node: Node) -> tuple[Column, Column, Column | None]:
        return getattr(self, f"_{node.op}")(node)

    def _score(self, node: Node):
        inner = node.args[0]
        name, field = self.plan.nodes[inner], field_of(inner)
        m, tf = self.model, F.col(f"tf_{name}").cast("double")
        match = F.col(f"tf_{name}") > 0
        if m.name == "unranked":
            return match, F.lit(1.0), None
        if m.name == "ranked":
            return match, tf, None
        dl, total = F.col(f"dl_{field}").cast("double"), F.col(f"sum_{field}").cast("double")
        if m.name == "bm25":
            n, df = F.col("num_docs").cast("double"), F.col(f"df_{name}").cast("double")
            idf = F.ln((n - df + F.lit(0.5)) / (df + F.lit(0.5)))
            average = total / F.col(f"docs_{field}").cast("double")
            return match, idf * (tf / (tf + F.lit(m.k1) * (F.lit(1.0 - m.b) + F.lit(m.b) * dl / average))), None
        p = F.when(total > 0, F.col(f"ctf_{name}").cast("double") / total).otherwise(F.lit(0.0))
        smoothed = lambda t: F.lit(1.0 - m.lam) * (t + F.lit(m.mu) * p) / (dl + F.lit(m.mu)) + F.lit(m.lam) * p
        return match, smoothed(tf), smoothed(F.lit(0.0))

    def _parts(self, node: Node):
        return [self.of(a) for a in node.args]

    def _any(self, parts):
        match = parts[0][0]
        for p in parts[1:]:
            match = match | p[0]
        return match

    def _and(self, node: Node):
        parts = self._parts(node)
        name = self.model.name
        if name == "indri":
            return self._product(parts, [1.0] * len(parts))
        match = parts[0][0]
        for p in parts[1:]:
            match = match & p[0]
        if name == "bm25":
            raise UnsupportedOperator("#and has no BM25 score")
        return match, F.lit(1.0) if name == "unranked" else F.least(*(p[1] for p in parts)), None

    def _or(self, node: Node):
        if self.model.name not in ("unranked", "ranked"):
            raise UnsupportedOperator(f"#or has no {self.model.name} score")
        parts = self._parts(node)
        score = F.lit(1.0) if self.model.name == "unranked" else F.greatest(*(F.when(p[0], p[1]) for p in parts))
        return self._any(parts), score, None

    def _sum(self, node: Node):
        parts = self._parts(node)
        if self.model.name != "bm25":
            return self._any(parts), F.lit(0.0), F.lit(0.0)
        score = F.lit(0.0)
        for match, s, _ in parts:
            score = score + F.when(match, s).otherwise(F.lit(0.0))
        return self._any(parts), score, None

    def _product(self, parts, weights):
        total = sum(weights)
        both = F.lit(0.0), F.lit(0.0)
        zero = F.lit(False), F.lit(False)
        for (match, s, d), w in zip(parts, weights):
            scores = F.when(match, s).otherwise(d), d
            zero = tuple(z | (x <= 0) for z, x in zip(zero, scores))
            both = tuple(a + F.lit(w) * F.ln(F.greatest(x, F.lit(5e-324))) for a, x in zip(both, scores))
        score, default = (F.when(z, F.lit(0.0)).otherwise(F.exp(a / F.lit(total))) for a, z in zip(both, zero))
        return self._any(parts), score, default

    def _wand(self, node: Node):
        if self.model.name != "indri":
            raise UnsupportedOperator("#wand is scored by the Indri model only")
        return self._product(self._parts(node), list(node.weights))

    def _wsum(self, node: Node):
        if self.model.name != "indri":
            raise UnsupportedOperator("#wsum is scored by the Indri model only")
        parts, total = self._parts(node), sum(node.weights)
        score = default = F.lit(0.0)
        for (match, s, d), w in zip(parts, node.weights):
            score = score + F.when(match, s).otherwise(d) * F.lit(w / total)
            default = default + d * F.lit(w / total)
        return self._any(parts), score, default


def scored(index: Index, queries: dict[str, str], model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """qid, doc_id, score of every match of a batch of queries, wrapped in the model's default operator and analysed as the index is."""
    trees = {q: parse(wrap(text, model.name), index.stop, index.stem, index.find) for q, text in queries.items()}
    return scored_trees(index, {q: t for q, t in trees.items() if t}, model, keep)


def scored_trees(index: Index, trees: dict[str, Node], model: Model, keep: tuple[str, ...] = (), gather=gathered, count=statistics) -> DataFrame:
    """keep: stored columns that come along. gather: what brings the postings of nodes together by document. count: what gives their statistics as one row."""
    plan = _Plan(list(trees.values()))
    if not plan.nodes:
        return index.table("documents").select(F.lit("").alias("qid"), "doc_id", *keep, F.lit(0.0).alias("score")).filter("false")
    rows, held = gather(index, list(plan.nodes))
    counted = rows.select("doc_id", *(f"dl_{f}" for f in plan.fields), *(frequency_of(n, held).alias(f"tf_{c}") for n, c in plan.nodes.items()))
    elsewhere = plan.fields if model.name == "indri" and len(plan.fields) > 1 else []  # lengths of fields that hold none of the terms
    if keep or elsewhere:
        counted = counted.drop(*(f"dl_{f}" for f in elsewhere)).join(index.table("documents").select("doc_id", *keep, *(f"dl_{f}" for f in elsewhere)), "doc_id")
    stats = count(index, plan.fields, {n: c for n, c in plan.nodes.items() if n.op == "term"})
    others = [c for n, c in plan.nodes.items() if n.op != "term"]
    if others:
        found = counted.agg(*(F.count_if(F.col(f"tf_{c}") > 0).alias(f"df_{c}") for c in others), *(F.coalesce(F.sum(f"tf_{c}"), F.lit(0)).alias(f"ctf_{c}") for c in others))
        stats = stats.crossJoin(F.broadcast(found))
    joined = counted.crossJoin(F.broadcast(stats))
    rules, results = _Scores(plan, model), []
    for qid, tree in trees.items():
        match, score, _ = rules.of(tree)
        results.append(F.when(match, F.struct(F.lit(qid).alias("qid"), score.alias("score"))))
    every = joined.select("doc_id", *keep, F.explode(F.filter(F.array(*results), lambda r: r.isNotNull())).alias("r"))
    return every.select("r.qid", "doc_id", *keep, "r.score")


def top_k(matches: DataFrame, k: int = 100, decimals: int = 6) -> DataFrame:
    """The best k of each query by score, then doc_id; ranks from 1. Scores are rounded, so that sums in another order rank alike."""
    rounded = matches.withColumn("score", F.round("score", decimals))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return rounded.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def search(index: Index, queries: dict[str, str], model: Model, k: int = 100) -> DataFrame:
    return top_k(scored(index, queries, model), k)
