"""Ordered and unordered proximity over arrays of positions, each as one sweep inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bound(args: list[Column], body) -> Column:
    """body(args) with every argument computed once for the row."""
    return let(F.struct(*(a.alias(f"a{i}") for i, a in enumerate(args))), lambda s: body([s[f"a{i}"] for i in range(len(args))]))


#: Bytes of matches that are gathered before they join the others, so that a match does not copy all before it.
_CHUNK = 512
_NONE = "array<int>"


def _kept(state: Column, value: Column, hit: Column) -> list[Column]:
    """``full`` and ``last`` of a state with one more match if there is a hit: four bytes each. A fold copies strings and arrays of its state at every step, bytes it does not."""
    more = F.concat(state["last"], F.unhex(F.lpad(F.hex(value), 8, "0")))
    flush = hit & (F.length(state["last"]) >= _CHUNK - 4)
    none = F.lit(bytearray())
    return [F.when(flush, F.concat(state["full"], more)).otherwise(state["full"]).alias("full"), F.when(flush, none).when(hit, more).otherwise(state["last"]).alias("last")]


def _empty() -> list[Column]:
    return [F.lit(bytearray()).alias("full"), F.lit(bytearray()).alias("last")]


def _matches(state: Column) -> Column:
    def read(raw):
        n = (F.length(raw) / 4).cast("int")
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(F.substring(raw, i * 4 + 1, 4)), 16, 10).cast("int"))
        return F.when(n > 0, each).otherwise(F.array().cast(_NONE))

    return let(F.concat(state["full"], state["last"]), read)


def _swept(args: list[Column], first: Column, step, turns: Column) -> Column:
    """One sweep: so many steps from a first state. A document that lacks an argument has no match."""
    empty = F.lit(False)
    for a in args:
        empty = empty | (F.size(a) == 0)
    none = F.array().cast(_NONE)
    return F.when(empty, none).otherwise(F.aggregate(F.when(empty, none).otherwise(F.sequence(F.lit(1), turns)), first, step, _matches))


def _with(state: Column, value: Column, body) -> Column:
    """body(state, value) with value computed once. Unlike ``let`` it copies nothing, so a state that has gathered much costs no more."""
    return F.aggregate(F.array(value), state, body)


def _cursors(args: list[Column], place) -> list[Column]:
    return [place(i).alias(f"i{i}") for i in range(len(args))]


def near(args: list[Column], distance: int) -> Column:
    """Positions of the last argument where each follows the one before within ``distance``.

    One sweep with a cursor in each argument, and no cursor ever moves back: a start lies past the last position reached,
    so what follows it does too. A step moves one cursor, or goes on to the next argument, or back to the first.
    """
    return _bound(args, lambda bound: _near(bound, distance))


def _near(args: list[Column], distance: int) -> Column:
    if len(args) == 1:
        return args[0]
    last = len(args) - 1

    def move(state, head):
        back = head <= F.when(state["turn"] == 0, state["skip"]).otherwise(state["reached"])
        close = (state["turn"] == 0) | (head - state["reached"] <= distance)
        hit = ~back & close & (state["turn"] == last)
        moved = F.struct(
            *_cursors(args, lambda i: F.when(back & (state["turn"] == i), state[f"i{i}"] + 1).otherwise(state[f"i{i}"])),
            F.when(back, state["turn"]).when(hit | ~close, 0).otherwise(state["turn"] + 1).alias("turn"),
            F.when(~back & close, head).otherwise(state["reached"]).alias("reached"),
            F.when(hit, head).when(~back & ~close, state["reached"]).otherwise(state["skip"]).alias("skip"),
            *_kept(state, head, hit),
        )
        return F.when(head.isNull(), state).otherwise(moved)  # an exhausted argument ends the document

    def step(state, _):
        head = F.lit(None).cast("int")
        for i, a in enumerate(args):
            head = F.when(state["turn"] == i, F.get(a, state[f"i{i}"])).otherwise(head)
        return _with(state, head, move)

    turns = F.size(args[0]) * (len(args) + 1) + len(args) + 1
    for a in args:
        turns = turns + F.size(a)
    first = F.struct(*_cursors(args, lambda i: F.lit(0)), F.lit(0).alias("turn"), F.lit(-1).alias("reached"), F.lit(-1).alias("skip"), *_empty())
    return _swept(args, first, step, turns)


def within(args: list[Column], width: int) -> Column:
    """Largest positions of places where all arguments stand within ``width``, in any order; every match uses its positions up.

    The state is one cursor per argument; a step advances all on a match, and otherwise those at the least position.
    """
    return _bound(args, lambda bound: _within(bound, width))


def _within(args: list[Column], width: int) -> Column:
    turns = F.lit(1)
    for a in args:
        turns = turns + F.size(a)

    def move(state, h):
        each = [h[f"h{i}"] for i in range(len(args))]
        low, high = (F.least(*each), F.greatest(*each)) if len(each) > 1 else (each[0], each[0])
        hit, over = high - low < width, F.lit(False)
        for x in each:
            over = over | x.isNull()
        moved = F.struct(*_cursors(args, lambda i: state[f"i{i}"] + F.when(hit | (each[i] == low), 1).otherwise(0)), *_kept(state, high, hit))
        return F.when(over, state).otherwise(moved)

    def step(state, _):
        return _with(state, F.struct(*(F.get(a, state[f"i{i}"]).alias(f"h{i}") for i, a in enumerate(args))), move)

    first = F.struct(*_cursors(args, lambda i: F.lit(0)), *_empty())
    return _swept(args, first, step, turns)


def synonyms(args: list[Column]) -> Column:
    """All positions of the arguments, sorted, duplicates kept."""
    return F.array_sort(F.concat(*args))


def at_or_past(positions: Column, place: Column) -> Column:
    """The first position that is not before a place; null if the list is exhausted."""
    return F.array_min(F.filter(positions, lambda x: x >= place))


def past(positions: Column, place: Column) -> Column:
    """The first position after a place; null if the list is exhausted."""
    return F.array_min(to_come(positions, place))


def to_come(positions: Column, place: Column) -> Column:
    """What is left of a list after a place."""
    return F.filter(positions, lambda x: x > place)


def appended(positions: Column, place: Column) -> Column:
    """A list and one more position; raises when a row is read whose last position is not before it."""
    grown = F.concat(positions, F.array(place.cast("int")))
    return F.when(F.coalesce(F.array_max(positions), F.lit(-1)) < place, grown).otherwise(F.raise_error(F.lit("positions must be appended in order")).cast("array<int>"))


def near_two(tokens: DataFrame, a: str, b: str, distance: int) -> DataFrame:
    """NEAR of two distinct terms over a token table (doc_id, pos, term): b matches if the element before it is an a close enough."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    pair = tokens.filter(F.col("term").isin(a, b)).withColumn("before", F.lag("term").over(order)).withColumn("from", F.lag("pos").over(order))
    hit = pair.filter((F.col("term") == b) & (F.col("before") == a) & (F.col("pos") - F.col("from") <= distance))
    return hit.groupBy("doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
