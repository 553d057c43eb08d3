"""MinHash near-duplicates with b-bit signatures.

Each text's set of word shingles gives minima in bands of ROWS. Bands of whole minima name candidates; of every minimum
BITS low bits are packed, and the count of equal lanes, corrected for chance collisions, estimates a pair's
similarity, so that only pairs that may reach the threshold are confirmed, on their full sets.

Texts with equal sets form one class, and classes are what is compared. In each bucket the classes are first linked
to one centre (the class that shares most buckets), each with its best centre only; those already joined need no
further comparison. Where a bucket still holds several components, its members are estimated block by block, and
those that may be linked across components form families; within a family, blocks of full sets are compared as
matrices. Neither step emits pairs: a block gives one edge per member. There are as many bands as the
threshold asks for (46 at 0.8, 30 at 0.85): a pair at the threshold shares no band with probability under MISSED and
is estimated below the bar with probability under 1e-5; all other results are exact.

Nulls: a null text has no words. A text without words links with nothing. A null doc_id is its own component's id
only if no other is in it. Rows with equal doc_id and text are alike in every column. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.graph import block_pairs, components, groups
from loomtext.llm.storage import Scratch, aside, map_batches, only, settle
from loomtext.llm.words import LOWER, NOT_SPACE, Block, blocks, mixed, prefix_hashes, span_hashes, starts_by_text

ROWS, BITS = 6, 4
#: Probability that a pair at the threshold shares no band.
MISSED = 1e-6
#: Standard deviations by which an estimate may fall short of the threshold before a pair is given up.
SIGMAS = 4.75
BLOCK = 2048
#: Texts of a family whose full sets meet in one matrix product, on either side.
EXACT_BLOCK = 256
#: Members that are confirmed against one copy of their centre's text.
PER_CENTRE = 256

_LANES = 64 // BITS
_LOW = np.uint64(sum(1 << (BITS * k) for k in range(_LANES)))


def bands_for(threshold: float) -> int:
    """How many bands leave a pair at the threshold in none with probability MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log(1 - threshold**ROWS)) if threshold < 1 else 1


def _multipliers(bands: int) -> np.ndarray:
    return mixed(np.arange(1, bands * ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def packed_words(bands: int) -> int:
    """64-bit words that hold BITS of each minimum."""
    return -(-bands * ROWS // _LANES)


def shingle_sets(block: Block, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; a text of fewer words is one shingle."""
    data = LOWER[block.data]
    start, end, owner = block.words(NOT_SPACE)
    words = span_hashes(prefix_hashes(data), start, end)
    n = len(words)
    rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size):
        rolled = mixed(rolled * np.uint64(0x9FB21C651E98DF25) + words[k : k + len(rolled)])
    bounds = starts_by_text(owner, len(block))
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= size:
            out.append(np.unique(rolled[low : high - size + 1]))
        elif high > low:
            whole = np.zeros(1, dtype=np.uint64)
            for w in words[low:high]:
                whole = mixed(whole * np.uint64(0x9FB21C651E98DF25) + w + np.uint64(high - low))
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _binary(data: np.ndarray, width: int) -> pa.Array:
    n = len(data)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _signatures(size: int, bands: int):
    width, multipliers = packed_words(bands), _multipliers(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, keys, packed = [], [], [], []
            for block in blocks(batch.column("text")):
                sets = shingle_sets(block, size)
                count = np.array([len(s) for s in sets], dtype=np.int64)
                node = np.zeros((len(sets), 2), dtype=np.uint64)
                minima = np.zeros((len(sets), bands * ROWS), dtype=np.uint64)
                some = np.flatnonzero(count)
                if len(some):
                    all_ = np.concatenate([sets[i] for i in some])
                    at = np.concatenate(([0], np.cumsum(count[some])[:-1]))
                    node[some, 0] = np.add.reduceat(mixed(all_), at)
                    node[some, 1] = np.add.reduceat(mixed(all_ ^ np.uint64(0x5851F42D4C957F2D)), at)
                    buffer = np.empty_like(all_)
                    for k, m in enumerate(multipliers):
                        np.multiply(all_, m, out=buffer)
                        minima[some, k] = np.minimum.reduceat(buffer, at)
                band = np.zeros((len(sets), bands), dtype=np.uint64)
                for r in range(ROWS):
                    band = mixed(band * np.uint64(0x9FB21C651E98DF25) + minima[:, r::ROWS])
                band = mixed(band + np.arange(bands, dtype=np.uint64))
                lanes = np.zeros((len(sets), width * _LANES), dtype=np.uint64)  # those that are left over are equal everywhere
                lanes[:, : bands * ROWS] = mixed(minima) & np.uint64((1 << BITS) - 1)
                lanes = lanes.reshape(len(sets), width, _LANES)
                packed.append(np.bitwise_or.reduce(lanes << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)), axis=2))
                counts.append(count)
                nodes.append(node)
                keys.append(band)
            if not batch.num_rows:
                continue
            count = np.concatenate(counts)
            cols = [batch.column("doc_id"), batch.column("text_key"), pa.array(count), _binary(np.concatenate(nodes), 16), _binary(np.concatenate(keys), 8 * bands), _binary(np.concatenate(packed), 8 * width)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_shingles", "node", "bands", "packed"])

    return run


def signatures(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (128 bits that name the set), bands, packed."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return map_batches(slim, _signatures(size, bands), "doc_id long, text_key long, n_shingles long, node binary, bands binary, packed binary")


def estimates(one: np.ndarray, many: np.ndarray, lanes: int) -> np.ndarray:
    """Similarities of packed signatures: the share of equal lanes, less what chance makes equal."""
    differ = one ^ many
    fold = differ.copy()
    for k in range(1, BITS):
        fold |= differ >> np.uint64(k)
    equal = 1 - np.bitwise_count(fold & _LOW).sum(-1) / lanes
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def bar(threshold: float, lanes: int) -> float:
    """The least estimate of a pair that may reach the threshold."""
    chance = 0.5**BITS
    p = chance + (1 - chance) * threshold
    return threshold - SIGMAS * (p * (1 - p) / lanes) ** 0.5 / (1 - chance)


def _unpacked(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, width)


def _estimate_rows(least: float, bands: int):
    def run(batches):
        for batch in batches:
            one, two = (_unpacked(batch.column(c), packed_words(bands)) for c in ("packed", "centre_packed"))
            e = estimates(one, two, bands * ROWS)
            table = pa.RecordBatch.from_arrays([batch.column("node"), batch.column("centre"), pa.array(e)], ["node", "centre", "estimate"])
            yield table.filter(pa.array(e >= least))

    return run


def _linked(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least index linked to each of n, by repeated minima along the edges."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, one, low[two])
        np.minimum.at(new, two, low[one])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _edges(node: np.ndarray, one: list[np.ndarray], two: list[np.ndarray]) -> pa.RecordBatch | None:
    """For the pairs found in a block, one edge per member: to the first of those it is joined with."""
    x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (one, two))
    if not len(x):
        return None
    root = _linked(len(node), x, y)
    some = np.flatnonzero(root != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node[some].tolist(), pa.binary()), pa.array(node[root[some]].tolist(), pa.binary())], ["node", "centre"])


def _sides(group: pa.Table) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
    side = group.column("_side").to_numpy()
    same = group.column("_i")[0].as_py() == group.column("_j")[0].as_py()
    left = np.flatnonzero(side == 0)
    return same, left, left if same else np.flatnonzero(side == 1), np.array(group.column("node").to_pylist(), dtype=object)


def _across(least: float, bands: int):
    """Joins the members of a bucket that stand in different components and may reach the threshold."""

    def run(batches):
        for group in groups(batches, ["key", "_i", "_j"]):
            same, left, right, node = _sides(group)
            _, label = np.unique(np.array(group.column("label").to_pylist(), dtype=object), return_inverse=True)
            packed = _unpacked(group.column("packed"), packed_words(bands))
            one, two = [], []
            for at, x in enumerate(left):
                rest = right[at + 1 :] if same else right
                rest = rest[label[rest] != label[x]]
                y = rest[estimates(packed[x], packed[rest], bands * ROWS) >= least]
                one.append(np.full(len(y), x))
                two.append(y)
            if (edges := _edges(node, one, two)) is not None:
                yield edges

    return run


#: Columns of the matrices of which shingle stands in which text.
COLUMNS = 1 << 14


def _exact(size: int, percent: int):
    """Links within a block by full sets: products of 0/1 matrices count common shingles. Gives one edge per member."""

    def run(batches):
        for group in groups(batches, ["family", "_i", "_j"]):
            same, left, right, node = _sides(group)
            sets = [s for block in blocks(group.column("text")) for s in shingle_sets(block, size)]
            count = np.array([len(s) for s in sets], dtype=np.int64)
            _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(sets)), count)
            row, column = row[times[column] > 1], column[times[column] > 1]
            _, column = np.unique(column, return_inverse=True)
            common = np.zeros((len(left), len(right)), dtype=np.float32)
            of_left, of_right = np.full(len(sets), -1), np.full(len(sets), -1)
            of_left[left], of_right[right] = np.arange(len(left)), np.arange(len(right))
            for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
                inside = (column >= at) & (column < at + COLUMNS)
                r, c = row[inside], column[inside] - at
                m = np.zeros((len(left), COLUMNS), dtype=np.float32)
                m[of_left[r[of_left[r] >= 0]], c[of_left[r] >= 0]] = 1
                k = m
                if not same:
                    k = np.zeros((len(right), COLUMNS), dtype=np.float32)
                    k[of_right[r[of_right[r] >= 0]], c[of_right[r] >= 0]] = 1
                common += m @ k.T
            common = common.astype(np.int64)
            x, y = np.nonzero(100 * common >= percent * (count[left][:, None] + count[right] - common))
            if (edges := _edges(node, [left[x]], [right[y]])) is not None:
                yield edges

    return run


def _confirm(size: int, percent: int):
    """Reads, for each centre, its text and then its members' texts; gives the links."""

    def run(batches):
        centre = name = None
        for batch in batches:
            links: tuple[list, list] = ([], [])
            cols = batch.to_pydict()
            done = 0
            for block in blocks(batch.column("text")):
                for s in shingle_sets(block, size):
                    i, done = done, done + 1
                    if cols["role"][i] == 0:
                        centre, name = s, cols["centre"][i]
                    else:
                        if name != cols["centre"][i]:
                            raise RuntimeError(f"the text of centre {cols['centre'][i]!r} is missing")
                        at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                        common = int((centre[at] == s).sum())
                        if 100 * common >= percent * (len(centre) + len(s) - common):
                            links[0].append(cols["node"][i])
                            links[1].append(name)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in links], ["node", "centre"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (node, centre), those whose full sets reach the threshold. texts: node, text."""
    many = pairs.groupBy("centre").agg(F.ceil(F.count("*") / PER_CENTRE).alias("salts"))
    asked = pairs.join(many, "centre").withColumn("salt", F.pmod(F.xxhash64("node"), "salts")).drop("salts")
    members = asked.join(texts, "node").select("centre", "salt", F.lit(1).alias("role"), "node", "text")
    centres = asked.select("centre", "salt").distinct().join(texts.withColumnRenamed("node", "centre"), "centre").select("centre", "salt", F.lit(0).alias("role"), F.col("centre").alias("node"), "text")
    ordered = members.unionByName(centres).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
    return map_batches(ordered, _confirm(size, percent), "node binary, centre binary")


def cluster(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links are pairs with 100 * intersection >= percent * union of their ``size``-word shingle sets.
    """
    found = _clustered(docs, size, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _clustered(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, group (that names its component; null without words), component_id."""
    docs, bands = only(docs, "doc_id", "text"), bands_for(percent / 100)
    least = bar(percent / 100, bands * ROWS)
    scratch = Scratch()
    signed = settle(signatures(docs, size, bands), "signatures")
    full = signed.filter("n_shingles > 0")
    classes = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    classes = scratch.settle(classes, "classes")
    piece = lambda i: F.substring("bands", i * 8 + 1, F.lit(8))
    banded = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, piece(i)))).alias("band", "key"))
    shared = scratch.settle(banded.join(banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key"), "shared-buckets")
    rank = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = scratch.settle(shared.join(rank, "node"), "weighed-buckets")
    centres = weighed.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("centre"))
    star = weighed.join(centres, "key").filter("node <> centre").select("node", "centre").distinct()
    packed = classes.select("node", "packed")
    estimated = star.join(packed, "node").join(packed.select(F.col("node").alias("centre"), F.col("packed").alias("centre_packed")), "centre")
    best = map_batches(estimated, _estimate_rows(least, bands), "node binary, centre binary, estimate double").groupBy("node").agg(F.max_by("centre", F.struct("estimate", "centre")).alias("centre"))
    best = scratch.settle(best, "best-centres")

    wanted = shared.select("node").distinct()
    chosen = signed.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = scratch.settle(_texts_of(docs, chosen, size), "texts")
    first = scratch.settle(confirm(best, texts, size, percent), "first-links")
    joined = components(first, "node", "centre", scratch)

    label = F.coalesce("label", "node").alias("label")
    members = shared.drop("size").join(joined, "node", "left").select("node", "band", "key", label)
    torn = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    loaded = members.join(torn, "key").join(packed, "node")
    blocked = block_pairs(loaded, ["key"], "node", BLOCK).repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j")
    families = components(map_batches(blocked, _across(least, bands), "node binary, centre binary"), "node", "centre", scratch)
    read = families.select("node", F.xxhash64("label").alias("family")).join(texts, "node")
    blocked = block_pairs(read, ["family"], "node", EXACT_BLOCK).repartition("family", "_i", "_j").sortWithinPartitions("family", "_i", "_j")
    second = map_batches(blocked, _exact(size, percent), "node binary, centre binary")
    labels = components(joined.withColumnRenamed("label", "centre").unionByName(second), "node", "centre", scratch)

    named = classes.join(labels, "node", "left").select("node", "doc_id", label)
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = settle(named.join(smallest, "label").select("node", "component_id", F.col("label").alias("group")), "components")
    scratch.drop()
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", "group", component.alias("component_id"))


def _node_of(size: int):
    def run(batches):
        for batch in batches:
            nodes = []
            for block in blocks(batch.column("text")):
                for s in shingle_sets(block, size):
                    nodes.append(np.array([mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column("text")], ["node", "text"])

    return run


def _texts_of(docs: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """One text of each class that shares a bucket; its node is taken from the text itself, as ids may repeat."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    same = F.col("doc_id").eqNullSafe(F.col("of_id"))
    some = own.join(chosen.select(F.col("doc_id").alias("of_id")).distinct(), same, "left_semi").select("text")
    return map_batches(some, _node_of(size), "node binary, text string").dropDuplicates(["node"])


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which each group of near duplicates keeps one: that with the smallest id.

    Rows are told apart by id and text. Where several rows of a group share the smallest id, one text of them stays;
    equal rows are one; a row whose id another group's row has too is judged in its own group.
    """
    docs, restored = aside(docs, "doc_id", "text")
    rows = settle(_clustered(docs, size, percent), "near-duplicates")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    twice = rows.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("of_id"))
    of_row = F.col("doc_id").cast("long").eqNullSafe(F.col("of_id"))
    gone = rows.filter(~first)
    if twice.isEmpty():  # an id tells a row
        return restored(docs.join(settle(gone.select(F.col("doc_id").alias("of_id")), "dropped"), of_row, "left_anti"))
    again = rows.filter(first & F.col("group").isNotNull()).join(twice, F.col("doc_id").eqNullSafe(F.col("of_id")), "left_semi")
    one = again.groupBy(F.col("group").alias("of_group"), F.col("doc_id").alias("of_id")).agg(F.min("text_key").alias("stays"))
    others = again.join(one, (F.col("group") == F.col("of_group")) & F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") > F.col("stays")))
    gone = gone.select("doc_id", "text_key").unionByName(others.select("doc_id", "text_key"))
    gone = settle(gone.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).distinct(), "dropped")
    left = docs.join(gone, of_row & (F.xxhash64("text") == F.col("of_key")), "left_anti")
    return restored(left.join(twice, of_row, "left_anti").unionByName(left.join(twice, of_row, "left_semi").dropDuplicates(["doc_id", "text"])))
