"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to classes: insults are stems learned from labelled rows, with weights; verbs of threat, targets,
negations and verbs of reporting are fixed lists. Five transducers read a clause's classes: one accepts insults, one
accepts a verb of threat together with a target, in either order, and three follow the scopes of a negation, of
reported speech and of a target. Their arcs carry weights, and composition pairs outputs and adds weights, so the
composed machine is one table of (state, class) to (state, output, weight). An accepted match has the strength
exp(weight of its arc and of its stem in the lexicon); a clause counts with its strongest match, a document with the sum over its
clauses, and a logistic function makes that a probability. Isolated words so never decide; what a negation, a report
or a target adds to a match is learned, from priors that hold where the sample shows none.

Learning takes about SAMPLE_TOXIC + SAMPLE_CLEAN labelled rows, those of a low hash of doc_id, one text of each. Nulls: a
null text scores as an empty one, rows with a null label are not learned from, without labels of both kinds every
score is the share of label 1 (0 if there are none). Rows are scored one by one, so repeated rows agree.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.minhash import shingle_sets
from loomtext.llm.storage import kept_model, map_batches, only
from loomtext.llm.words import LOWER, Block, blocks, prefix_hashes, span_hashes, starts_by_text, table_of

SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 7500
#: Minima of which near copies share at least one.
FAMILY_MINIMA = 4
SHORTEST_STEM, LONGEST_STEM = 4, 16
#: Standard errors by which a stem's log odds are lowered, so that few rows make no heavy stem.
DOUBT = 1.5
#: What a unit of squared distance from the priors costs, in log likelihood.
SHRINK = 0.02
THRESHOLD = 0.3

#: Closed word classes of the four languages.
TARGETS = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os su sus".split()
NEGATIONS = "not no never none cannot don't isn't aren't wasn't nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna tampoco".split()
REPORTS = "said says say saying called calls wrote writes quoted quote according sagte sagt schrieb nannte zitierte laut dit disait écrit appelé selon dijo dice decía escribió llamó según".split()
THREATS = "kill hurt destroy die burn beat murder attack töten umbringen schlagen sterben tuer frapper mourir détruire matar golpear morir destruir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: A negation reaches so many words ahead.
REACH = 3

_WORD = table_of([0x27, *range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_BREAK = table_of(map(ord, ".;:!?\n"))


class Transducer:
    """States numbered from 0 (the first); step[state][class] is (state, output, weight). Outputs are below 2 ** bits."""

    def __init__(self, step: list[list[tuple[int, int, float]]], bits: int = 1):
        self.step, self.bits = step, bits

    def composed(self, other: Transducer) -> Transducer:
        """Both read the same word: outputs stand side by side, weights add."""
        n = len(other.step)
        rows = [[(a2 * n + b2, x << other.bits | y, v + w) for (a2, x, v), (b2, y, w) in zip(a, b)] for a, b in itertools.product(self.step, other.step)]
        return Transducer(rows, self.bits + other.bits)


def word(accepted: int, weight: float) -> Transducer:
    """Accepts every word of a class."""
    return Transducer([[(0, int(c == accepted), weight if c == accepted else 0.0) for c in range(END + 1)]])


def together(one: int, two: int, weight: float) -> Transducer:
    """Accepts a word of class ``one`` once a word of class ``two`` has stood in the clause, or the first of class ``two`` after one of class ``one``."""
    table = []
    for s in range(3):  # nothing yet; two; one that waits for two
        row = [(s, 0, 0.0) for _ in range(END + 1)]
        row[END] = (0, 0, 0.0)
        row[one] = (1, 1, weight) if s == 1 else (2, 0, 0.0)
        row[two] = (1, 1, weight) if s == 2 else (1, 0, 0.0)
        table.append(row)
    return Transducer(table)


def scope(opening: int, reach: int | None, weight: float) -> Transducer:
    """Outputs 1, and adds the weight, within the scope that a word of a class opens: so many words, or (None) to the clause's end."""
    states = 2 if reach is None else reach + 1
    table = []
    for s in range(states):
        later = s if reach is None else max(0, s - 1)
        table.append([(0 if c == END else states - 1 if c == opening else later, int(s > 0), weight if s > 0 else 0.0) for c in range(END + 1)])
    return Transducer(table)


#: Arc weights before learning, which shrinks towards them: what a stem's log odds count, a threat, and a match within each scope.
PRIORS = {"lexicon": 0.5, "threat": 2.0, "negated": -2.0, "reported": -2.0, "addressed": 0.5}


def grammar(weights: dict[str, float]) -> Transducer:
    """Output bits, from the highest: insult, threat, negated, reported, addressed."""
    accepting = word(INSULT, 0.0).composed(together(THREAT, TARGET, weights["threat"]))
    return accepting.composed(scope(NEGATION, REACH, weights["negated"])).composed(scope(REPORT, None, weights["reported"])).composed(scope(TARGET, None, weights["addressed"]))


class Model:
    def __init__(self, stems: dict[bytes, float], bias: float):
        self.stems, self.bias, self.slope = stems, bias, 0.0
        self.weights, self.grammar = dict(PRIORS), grammar(PRIORS)
        by: dict[int, list[tuple[int, float]]] = {}
        for stem, weight in stems.items():
            by.setdefault(len(stem), []).append((_hash(stem), weight))
        self.by_length = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([w for _, w in sorted(x)])) for n, x in by.items()}
        fixed = [(_hash(w.encode()), c) for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words]
        fixed = sorted(dict(fixed).items())
        self.fixed, self.fixed_class = np.array([h for h, _ in fixed], np.uint64), np.array([c for _, c in fixed])

    def classes(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lexicon: class and stem weight of each word, and the text and clause it stands in."""
        data = LOWER[block.data]
        start, end, owner = block.words(_WORD)
        prefix, weight = prefix_hashes(data), np.zeros(len(start))
        for n, (hashes, weights) in self.by_length.items():
            some = np.flatnonzero(end - start >= n)
            h = span_hashes(prefix, start[some], start[some] + n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            weight[some[hit]] = np.maximum(weight[some[hit]], weights[at[hit]])
        fixed = span_hashes(prefix, start, end)
        at = np.minimum(np.searchsorted(self.fixed, fixed), len(self.fixed) - 1)
        class_ = np.where(weight > 0, INSULT, np.where(self.fixed[at] == fixed, self.fixed_class[at], OTHER))
        return class_, weight, owner, np.cumsum(_BREAK[block.data])[start] + owner  # a new text is a new clause

    def matches(self, block: Block) -> list[tuple[int, int, int, float, float]]:
        """Text, clause, output, arc weight and stem weight of every accepted match. Of the machine's run, words of no class are skipped at once."""
        out: list[tuple[int, int, int, float, float]] = []
        class_, weight, owner, clause = self.classes(block)
        bounds, step = starts_by_text(owner, len(block)), self.grammar.step
        accepted = 3 << self.grammar.bits - 2
        for text in np.unique(owner[(class_ == INSULT) | (class_ == THREAT)]).tolist():
            low, high = bounds[text], bounds[text + 1]
            some = low + np.flatnonzero(class_[low:high])
            state, where, before = 0, -1, 0
            for i, c, k, w in zip(some.tolist(), class_[some].tolist(), clause[some].tolist(), weight[some].tolist()):
                if k != where:
                    state, where = 0, k
                else:
                    for _ in range(min(REACH, i - before - 1)):
                        state = step[state][OTHER][0]
                state, kind, arc = step[state][c]
                before = i
                if kind & accepted:
                    out.append((text, k, kind, arc, w if c == INSULT else 0.0))
        return out

    def sums(self, texts: pa.Array) -> np.ndarray:
        """Per text, the sum over its clauses of the strongest match."""
        out, at = np.zeros(len(texts)), 0
        for block in blocks(texts):
            found = self.matches(block)
            if found:
                text, clause, _, arc, weight = (np.array(x) for x in zip(*found))
                _, first, of = np.unique(clause, return_index=True, return_inverse=True)
                best = np.zeros(len(first))
                np.maximum.at(best, of, np.exp(arc + self.weights["lexicon"] * weight))
                np.add.at(out, at + text[first], best)
            at += len(block)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(self.sums(texts)) + self.bias, -30, 30)))


def _hash(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(span_hashes(prefix_hashes(data), np.array([0]), np.array([len(word)]))[0])


def learn_stems(texts: list[str], labels: np.ndarray) -> dict[bytes, float]:
    """Stems that stand in toxic rows far oftener than chance, by a likelihood ratio against the number of stems tried."""
    toxic, all_ = Counter(), Counter()
    for text, y in zip(texts, labels):
        words = {w for b in blocks(pa.array([text])) for w in _plain_words(b)}
        tried = {w[:n] for w in words for n in range(SHORTEST_STEM, min(len(w), LONGEST_STEM) + 1)}
        all_.update(tried)
        if y:
            toxic.update(tried)
    share = labels.mean()
    bar, found = np.log(max(2, sum(n >= 3 for n in all_.values()))) + 2, []
    for stem, n1 in toxic.items():
        n, n0 = all_[stem], all_[stem] - n1
        ratio = n1 * np.log(n1 / n / share) + (n0 * np.log(n0 / n / (1 - share)) if n0 else 0)
        if n1 / n > share and ratio > bar:
            found.append((-ratio, -len(stem), stem, np.log((n1 + 0.5) / (n0 + 0.5)) - DOUBT * np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5)) - np.log(share / (1 - share))))
    stems: dict[bytes, float] = {}
    for _, _, stem, weight in sorted(found):
        if weight > 1 and not any(stem[:n] in stems for n in range(SHORTEST_STEM, len(stem))) and not any(s.startswith(stem) and w >= weight for s, w in stems.items()):
            stems[stem] = float(weight)
    return stems


def _plain_words(block: Block) -> list[bytes]:
    """The words of a block that stand in no scope of a negation or of reported speech."""
    data = LOWER[block.data]
    start, end, _ = block.words(_WORD)
    prefix, raw = prefix_hashes(data), data.tobytes()
    hashes, clause = span_hashes(prefix, start, end), np.cumsum(_BREAK[block.data])[start]
    first = np.searchsorted(clause, clause)
    said, denied = (np.concatenate(([0], np.cumsum(np.isin(hashes, [_hash(w.encode()) for w in words])))) for words in (REPORTS, NEGATIONS))
    at = np.arange(len(start))
    free = (said[at] == said[first]) & (denied[at] == denied[np.maximum(first, at - REACH)])
    return [raw[s:e] for s, e in zip(start[free].tolist(), end[free].tolist())]


def distinct_texts(texts: list[str]) -> np.ndarray:
    """One index of each family of near copies: texts that share one of a few minima of their word shingles."""
    family, seen = np.arange(len(texts)), [{} for _ in range(FAMILY_MINIMA)]
    done = 0
    for block in blocks(pa.array(texts, pa.large_string())):
        for shingles in shingle_sets(block, 3):
            for known, k in zip(seen, range(1, FAMILY_MINIMA + 1) if len(shingles) else ()):
                least = int((shingles * np.uint64(2 * k + 1)).min())
                family[done] = min(family[done], known.setdefault(least, family[done]))
            done += 1
    return np.flatnonzero(family == np.arange(len(texts)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, bias and loss of one feature, by Newton's method with a slight ridge on the slope."""
    x1, layer, ridge = np.column_stack((x, np.ones(len(x)))), np.zeros(2), np.array([0.05, 1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x1 @ layer, -30, 30)))
        layer -= np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(ridge), x1.T @ (p - y) + ridge * layer)
    z = np.clip(x1 @ layer, -30, 30)
    return float(layer[0]), float(layer[1]), float(np.logaddexp(0, z).sum() - (z * y).sum() + 0.5 * ridge[0] * layer[0] ** 2)


def learn_weights(model: Model, texts: list[str], y: np.ndarray) -> None:
    """Arc weights by a search along each of them, steps halved as none helps; the logistic function is fitted at every trial."""
    found, at, clauses = [], 0, 0
    for block in blocks(pa.array(texts, pa.large_string())):
        found += [(at + text, clauses + clause, kind, w) for text, clause, kind, _, w in model.matches(block)]
        at, clauses = at + len(block), clauses + len(block.data) + 1
    if not found:
        return
    text, clause, kind, weight = (np.array(x) for x in zip(*found))
    _, first, of = np.unique(clause, return_index=True, return_inverse=True)
    threat, negated, reported, addressed = ((kind >> k) & 1 for k in (3, 2, 1, 0))
    bits = {"lexicon": weight, "threat": threat, "negated": negated, "reported": reported, "addressed": addressed}

    def tried(weights: dict[str, float]) -> tuple[float, float, float]:
        arc, best, total = sum(weights[k] * bits[k] for k in bits), np.zeros(len(first)), np.zeros(len(texts))
        np.maximum.at(best, of, np.exp(arc))
        np.add.at(total, text[first], best)
        slope, bias, loss = _logistic(np.log1p(total), y)
        return loss + sum(SHRINK * (weights[k] - PRIORS[k]) ** 2 for k in weights), slope, bias

    weights, step = dict(PRIORS), 1.0
    least, slope, bias = tried(weights)
    while step > 0.1:
        better = False
        for k in weights:
            for sign in (1, -1):
                now = weights | {k: min(6.0, max(-6.0, weights[k] + sign * step))}
                loss, a, b = tried(now)
                if loss < least - 1e-6:
                    least, slope, bias, weights, better = loss, a, b, now, True
        step = step if better else step / 2
    model.weights, model.grammar, model.slope, model.bias = weights, grammar(weights), slope, bias


def fit(texts: list[str], labels: np.ndarray, prior: float) -> Model:
    """Stems, then arc weights; the bias is set for the share of toxic rows before sampling.

    Of near copies one is learned from, else the words of a text with many copies pass for a pattern.
    """
    once = distinct_texts(texts)
    if 0 < labels[once].sum() < len(once):
        texts, labels = [texts[i] for i in once], labels[once]
    share = labels.mean()
    model = Model(learn_stems(texts, labels), float(np.log(share / (1 - share))))
    learn_weights(model, texts, labels.astype(float))
    model.bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def train(docs: DataFrame, labels: DataFrame, learnable: Column) -> Model:
    docs, labels = only(docs, "doc_id", "text"), only(labels, "doc_id", "toxic")
    known = labels.filter(learnable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(1) or not counts.get(0):
        prior = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 1e-9), 1 - 1e-9)
        return Model({}, float(np.log(prior / (1 - prior))))
    share = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1 << 31)) / float(1 << 31)
    sample = known.filter(share < F.when(F.col("toxic") == 1, SAMPLE_TOXIC / counts[1]).otherwise(SAMPLE_CLEAN / counts[0]))
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id")
    rows = some.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow()
    order = np.lexsort((np.array(rows["doc_id"]),))
    texts, y = rows["text"].to_pylist(), np.array(rows["toxic"]).astype(float)
    texts, y = [texts[i] for i in order], y[order]
    if not 0 < y.sum() < len(y):
        return Model({}, float(np.log(counts[1] / counts[0])))
    prior = counts[1] / (counts[0] + counts[1])
    return kept_model(docs.sparkSession, "toxicity", (texts, y.tolist(), prior, PRIORS, SHRINK), lambda: fit(texts, y, prior))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(n) for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.scores(batch.column("text")), pa.float64())], [*(n for n in batch.schema.names if n != "text"), "score"])

    return run


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    scored = map_batches(only(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), _score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
