"""Selectors given as strings: tags, classes, ids and attributes, inside or directly in others."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.select import attr, before, has_attr, has_class, has_id, nearest, tag

_NAME = r"[A-Za-z_\u0080-\U0010FFFF-][\w\u0080-\U0010FFFF-]*"
_PART = re.compile(
    rf"(?P<tag>{_NAME}|\*)|\.(?P<cls>{_NAME})|#(?P<id>{_NAME})"
    rf"|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~^$*|]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*)?\]"
    r"|:not\((?P<not>[^()]*)\)")
_BETWEEN = re.compile(r"\s*([>,])\s*|\s+")


@dataclass(frozen=True)
class Step:
    """Tests that one element passes, and how it stands to the element of the step before: ``inside`` or ``directly`` in it."""

    tests: tuple[tuple[str, ...], ...]
    link: str = "inside"


def parse(selector: str) -> list[list[Step]]:
    """Alternatives of a selector, each a chain of steps from the outermost to the element itself.

    Understood are ``tag``, ``*``, ``.class``, ``#id``, ``[name]``, ``[name=value]`` and ``~= ^= $= *= |=``, ``:not(...)`` of
    these, a space for inside, ``>`` for directly inside, and ``,`` between alternatives.  Anything else is an error.
    """
    chains: list[list[Step]] = [[]]
    at, text, link, tests = 0, selector.strip(), "inside", []

    def close() -> None:
        if not tests:
            raise ValueError(f"selector {selector!r}: nothing to match before place {at}")
        chains[-1].append(Step(tuple(tests), link))
        tests.clear()

    while at < len(text):
        if part := _PART.match(text, at):
            found = {k: v for k, v in part.groupdict().items() if v is not None}
            if "tag" in found and tests:
                raise ValueError(f"selector {selector!r}: a tag must come first, at place {at}")
            tests.append(_test(found, selector))
            at = part.end()
        elif between := _BETWEEN.match(text, at):
            close()
            at = between.end()
            link = "directly" if between[1] == ">" else "inside"
            if between[1] == ",":
                chains.append([])
        else:
            raise ValueError(f"selector {selector!r} is not understood at place {at}")
    close()
    return chains


def _test(found: dict[str, str], selector: str) -> tuple[str, ...]:
    if "not" in found:
        inner = parse(found["not"])
        if len(inner) != 1 or len(inner[0]) != 1:
            raise ValueError(f"selector {selector!r}: :not() takes one element's tests")
        return ("not", *inner[0][0].tests)
    if "attr" in found:
        value = found.get("value", "")
        return "attr", found["attr"].lower(), found.get("op", ""), value[1:-1] if value[:1] in ("'", '"') else value
    kind, value = next(iter(found.items()))
    return kind, value.lower() if kind == "tag" else value


def matches(tests) -> Column:
    """Whether a node row passes all tests of a step; never null."""
    return reduce(lambda a, b: a & b, map(_passes, tests))


def _passes(test: tuple) -> Column:
    kind, *rest = test
    if kind == "tag":
        return ~tag("#text", "#document") if rest[0] == "*" else tag(rest[0])
    if kind == "cls":
        return has_class(rest[0])
    if kind == "id":
        return has_id(rest[0])
    if kind == "not":
        return ~matches(rest) & ~tag("#text", "#document")
    name, op, value = rest
    held = attr(name)
    some = {
        "": has_attr(name), "=": held == value, "^=": held.startswith(value), "$=": held.endswith(value), "*=": held.contains(value),
        "~=": F.array_contains(F.split(held, r"[ \t\n\f\r]+"), value), "|=": (held == value) | held.startswith(value + "-"),
    }[op]
    # No value begins, ends or holds the empty string, and none is a word.
    never = op in ("^=", "$=", "*=", "~=") and (value == "" or op == "~=" and re.search(r"\s", value))
    return F.lit(False) if never else F.coalesce(some, F.lit(False))


def selected(nodes: DataFrame, name: str, selector: str) -> DataFrame:
    """Add ``name``: whether the selector picks the row.

    Each step that stands inside the one before asks whether one of its matches is open at the row, a running maximum over the
    page; a step directly inside asks for the nearest open match and compares it with the row's parent.  There is
    no join, and the page may nest to any depth.
    """
    flags = []
    for i, chain in enumerate(parse(selector)):
        own = matches(chain[0].tests)
        for step in chain[1:]:
            if step.link == "directly":
                nodes = nearest(nodes.withColumn("_outer", own), F.col("_outer"), "_around").drop("_outer")
                around = F.col("_around.start") == F.col("parent")
            else:
                nodes = nodes.withColumn("_around", F.max(F.when(own, F.col("end"))).over(before()))
                around = F.col("_around") >= F.col("start")
            nodes = nodes.withColumn(f"_{name}{i}", F.coalesce(around, F.lit(False)) & matches(step.tests)).drop("_around")
            own = F.col(f"_{name}{i}")
        nodes = nodes.withColumn(f"_{name}{i}", own)
        flags.append(f"_{name}{i}")
    return nodes.withColumn(name, reduce(lambda a, b: a | b, map(F.col, flags))).drop(*flags)


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The rows that a selector picks, each once, in any order."""
    return selected(nodes, "_picked", selector).where("_picked").drop("_picked")
