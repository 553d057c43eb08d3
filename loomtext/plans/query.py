"""The query language: a tree of operators, its parser, and the rewrites that precede compilation.

query := op '(' arg* ')' ;  arg := [weight] ( query | term ['.' field] )
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

FIELDS = ("url", "keywords", "title", "body", "inlink")
#: The operator that wraps a query of each model.
DEFAULT_OPERATOR = {"unranked": "#or", "ranked": "#or", "bm25": "#sum", "indri": "#and"}
POSITIONAL, SCORED = ("term", "syn", "near", "window"), ("score", "and", "or", "sum", "wand", "wsum")


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """op: one of POSITIONAL or SCORED; weights stand beside args for wand and wsum, and go with their arg."""

    op: str
    args: tuple["Node", ...] = ()
    weights: tuple[float, ...] = ()
    term: str = ""
    field: str = "body"
    distance: int = 0

    @property
    def positional(self) -> bool:
        return self.op in POSITIONAL

    def __str__(self) -> str:
        if self.op == "term":
            return f"{self.term}.{self.field}"
        name = f"#{self.op}" + (f"/{self.distance}" if self.op in ("near", "window") else "")
        inner = [f"{w:g} {a}" for w, a in zip(self.weights, self.args)] if self.weights else map(str, self.args)
        return f"{name}({' '.join(inner)})"


def wrap(query: str, model: str) -> str:
    return f"{DEFAULT_OPERATOR[model]}({query})"


def analysed(word: str, stop: tuple[str, ...] = (), stem=None, find=None) -> list[str]:
    """Terms of one query word: none for a stopword, several where it holds other signs. find: what cuts it into tokens."""
    found = [t for t in (find or re.compile(r"[^\W_]+").findall)(word.lower()) if t not in stop]
    return [stem(t) for t in found] if stem else found


def term_of(word: str, stop: tuple[str, ...], stem=None, find=None) -> list[Node]:
    name, _, field = word.rpartition(".") if find else word.partition(".")
    if find and field not in FIELDS:  # a point within a word
        name, field = word, ""
    if field and field not in FIELDS:
        raise QuerySyntaxError(f"unknown field in {word}")
    return [Node("term", term=t, field=field or "body") for t in analysed(name, stop, stem, find)]


def _operator(word: str) -> Node:
    found = re.fullmatch(r"#(and|or|syn|sum|wand|wsum|near|window)(?:/(\S*))?", word[word.index("#") :].lower())
    if not found or found[1] in ("near", "window") and found[2] is None:
        raise QuerySyntaxError(f"unknown operator {word}")
    digits = found[2] if found[2] and found[2].isdigit() else "0"
    return Node(found[1], distance=int(digits) if found[1] in ("near", "window") else 0)


def parse(query: str, stop: tuple[str, ...] = (), stem=None, find=None) -> Node | None:
    """The rewritten tree, or None where nothing is left of the query."""
    words = re.findall(r"[()]|[^\s()]+", query)
    if not words or "(" not in words or words.count("(") != words.count(")"):
        raise QuerySyntaxError(f"parentheses are missing or unbalanced: {query}")
    node, end = _parse(words, 0, stop, stem, find)
    if end != len(words):
        raise QuerySyntaxError(f"text after the last parenthesis: {query}")
    node = simplified(node)
    return typed(node) if node else None


def _parse(words: list[str], at: int, stop, stem, find) -> tuple[Node, int]:
    if "#" not in words[at] or at + 1 >= len(words) or words[at + 1] != "(":
        raise QuerySyntaxError(f"an operator is expected at {words[at]}")
    node, args, weights = _operator(words[at]), [], []
    at += 2
    while at < len(words) and words[at] != ")":
        weight = 1.0
        if node.op in ("wand", "wsum"):
            try:
                weight = float(words[at])
            except ValueError:
                raise QuerySyntaxError(f"a weight is expected at {words[at]}") from None
            at += 1
            if at >= len(words) or words[at] == ")":
                raise QuerySyntaxError("a weight without an argument")
        if "#" in words[at]:
            arg, at = _parse(words, at, stop, stem, find)
            found = [arg]
        elif words[at] == "(":
            raise QuerySyntaxError("a parenthesis without an operator")
        else:
            found, at = term_of(words[at], stop, stem, find), at + 1
        args += found
        weights += [weight] * len(found)
    if at >= len(words):
        raise QuerySyntaxError("a parenthesis is not closed")
    return replace(node, args=tuple(args), weights=tuple(weights) if node.op in ("wand", "wsum") else ()), at + 1


def simplified(node: Node) -> Node | None:
    """Drops nodes without arguments (with their weights) and replaces those of one argument by it."""
    if node.op == "term":
        return node
    kept = [(simplified(a), w) for a, w in zip(node.args, node.weights or (1.0,) * len(node.args))]
    kept = [(a, w) for a, w in kept if a]
    if not kept:
        return None
    if len(kept) == 1 and node.op != "score":
        return kept[0][0]
    return replace(node, args=tuple(a for a, _ in kept), weights=tuple(w for _, w in kept) if node.weights else ())


def typed(node: Node) -> Node:
    """Puts a score node between scored and positional ones, and checks what may stand where."""
    if node.op == "term":
        return Node("score", (node,))
    if node.positional:
        return Node("score", (_positional(node),))
    args = tuple(typed(a) if not (a.op == "score") else a for a in node.args)
    return replace(node, args=args)


def _positional(node: Node) -> Node:
    if node.op == "term":
        return node
    if not node.positional:
        raise QuerySyntaxError(f"#{node.op} cannot stand within a positional operator")
    args = tuple(_positional(a) for a in node.args)
    if len({field_of(a) for a in args}) > 1:
        raise QuerySyntaxError("arguments of a positional operator must share a field")
    return replace(node, args=args, field=field_of(args[0]))


def field_of(node: Node) -> str:
    return node.field if node.op == "term" else field_of(node.args[0])
