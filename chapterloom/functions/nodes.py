"""Predicates, selectors and subtree removal over a page's node array.

All of them are single passes (``filter`` / ``aggregate``) that use the
pre-order numbering: the subtree of a node is the id range [id, last].
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .text import filled, let, strip

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Step:
    """One compound step of a selector; unset parts match anything."""

    tag: str | None = None
    cls: tuple[str, ...] = ()
    id: str | None = None
    attr: str | None = None
    prefix: str | None = None
    equals: str | None = None

    def test(self, node: Column) -> Column:
        found = node["kind"] == "el"
        if self.tag:
            found &= node["tag"] == self.tag
        for name in self.cls:
            found &= F.coalesce(
                F.array_contains(F.split(node["attrs"]["class"], r"\s+"), name), F.lit(False)
            )
        if self.id:
            found &= F.coalesce(node["attrs"]["id"] == self.id, F.lit(False))
        if self.attr:
            value = node["attrs"][self.attr]
            if self.equals is not None:
                found &= F.coalesce(value == self.equals, F.lit(False))
            elif self.prefix is not None:
                found &= F.coalesce(value.startswith(self.prefix), F.lit(False))
            else:
                found &= value.isNotNull()
        return found


def el(tag: str | None = None, *cls: str, id: str | None = None, attr: str | None = None,
       prefix: str | None = None, equals: str | None = None) -> Step:
    return Step(tag, cls, id, attr, prefix, equals)


#: A path is a run of steps, each below the one before; a group is a list of
#: paths of which the first hit in document order counts.
Path = tuple[Step, ...]
Group = tuple[Path, ...]


def path(*steps: Step) -> Group:
    return (steps,)


def either(*groups: Group) -> Group:
    return tuple(p for group in groups for p in group)


def matches(nodes: Column, group: Group) -> Column:
    """Nodes matched by any path of the group, in document order."""
    if all(len(p) == 1 for p in group):
        tests = [p[0] for p in group]
        return F.filter(nodes, lambda x: _any([t.test(x) for t in tests]))
    # until[k] is the end of the subtrees opened by the first k+1 steps of a
    # path; ranges nest, so "below such a node" is simply id <= until.
    slots = [(i, k) for i, p in enumerate(group) for k in range(len(p) - 1)]

    def slot(i: int, k: int) -> str:
        return f"u{i}_{k}"

    def advance(acc: Column, x: Column) -> Column:
        fields, hits = [], []
        for i, p in enumerate(group):
            for k, step in enumerate(p):
                inside = step.test(x)
                if k:
                    inside = (acc[slot(i, k - 1)] >= x["id"]) & inside
                if k == len(p) - 1:
                    hits.append(inside)
                else:
                    end = acc[slot(i, k)]
                    fields.append(
                        F.when(inside, F.greatest(end, x["last"])).otherwise(end).alias(slot(i, k))
                    )
        found = F.when(_any(hits), F.array_append(acc["hits"], x)).otherwise(acc["hits"])
        # Most nodes are text, which no step matches.
        return F.when(x["kind"] == "el", F.struct(*fields, found.alias("hits"))).otherwise(acc)

    none = F.filter(nodes, lambda x: F.lit(False))
    zero = F.struct(*[F.lit(0).alias(slot(i, k)) for i, k in slots], none.alias("hits"))
    return F.aggregate(nodes, zero, advance, lambda acc: acc["hits"])


def _any(tests: Sequence[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def first(nodes: Column, group: Group) -> Column:
    """The first match in document order, or null."""
    return F.get(matches(nodes, group), 0)


def first_of(nodes: Column, groups: Sequence[Group]) -> Column:
    """The first group that matches at all decides: rule order beats document order."""
    return F.coalesce(*[first(nodes, group) for group in groups])


def below(nodes: Column, node: Column) -> Column:
    """The node's subtree, itself included; null when the node is null."""
    def within(root: Column) -> Column:
        inside = F.filter(nodes, lambda x: (x["id"] >= root["id"]) & (x["id"] <= root["last"]))
        return F.when(root["id"].isNotNull(), inside)

    return let(node, within)


def inside(page: Column, node: Column) -> Column:
    """As ``below``, for an untouched page array, where position equals id."""
    return let(node, lambda root: F.slice(page, root["id"], root["last"] - root["id"] + 1))


def text_parts(nodes: Column) -> Column:
    stripped = F.transform(F.filter(nodes, lambda x: x["kind"] == "tx"), lambda x: strip(x["text"]))
    return F.filter(stripped, lambda t: t != "")


def text_of(nodes: Column, sep: str = " ") -> Column:
    """Visible text: stripped pieces joined by ``sep``; scripts and styles do not count."""
    return F.array_join(text_parts(nodes), sep)


def steps_of(*groups: Group) -> list[Step]:
    """All steps of some selectors, each once."""
    return list(dict.fromkeys(step for group in groups for p in group for step in p))


def candidates(nodes: Column, steps: Sequence[Step]) -> Column:
    """Nodes that any of the steps tests true: what selectors made of these steps find among them is what they find in the page.

    One pass over the page, however many selectors follow: ancestry is told by id ranges, which need no other nodes.
    """
    by_tag: dict[str | None, list[Step]] = {}
    for step in steps:
        by_tag.setdefault(step.tag, []).append(step)

    def wanted(x: Column) -> Column:
        named = [(x["tag"] == tag) & _any([s.test(x) for s in own]) for tag, own in by_tag.items() if tag]
        return (x["kind"] == "el") & _any([*named, *(s.test(x) for s in by_tag.get(None, []))])

    return F.filter(nodes, wanted)


def first_text(nodes: Column, groups: Sequence[Group], among: Column | None = None) -> Column:
    """Text of the first group whose first match has any; null when none has.

    With ``among``, the selectors' candidates of an untouched page, only those are searched.
    """
    if among is not None:
        return F.coalesce(*[filled(text_of(inside(nodes, first(among, g)))) for g in groups])
    return F.coalesce(*[filled(text_of(below(nodes, first(nodes, g)))) for g in groups])


META_ATTRS = ("property", "name", "itemprop")


def meta(nodes: Column, names: Sequence[str]) -> Column:
    """Content of the first usable meta tag, by name and then by attribute.

    For every (name, attribute) pair only the first tag counts, even if its
    content is empty; the next pair is tried then.
    """
    # The pairs travel as one literal; a pair's first tag is looked up by key.
    pairs = F.split(F.lit("\n".join(f"{a}\t{n}" for n in names for a in META_ATTRS)), "\n")

    def content(tags: Column, pair: Column) -> Column:
        attr, name = F.split_part(pair, F.lit("\t"), F.lit(1)), F.split_part(pair, F.lit("\t"), F.lit(2))
        tag = F.get(F.filter(tags, lambda t: F.coalesce(t["attrs"][attr] == name, F.lit(False))), 0)
        return tag["attrs"]["content"]

    def lookup(tags: Column) -> Column:
        values = F.transform(pairs, lambda pair: content(tags, pair))
        return strip(F.get(F.filter(values, lambda v: F.coalesce(v != "", F.lit(False))), 0))

    return let(F.filter(nodes, lambda x: x["tag"] == "meta"), lookup)


def subtree_roots(nodes: Column, doomed: Test) -> Column:
    """Outermost doomed nodes as (id, last) ranges, in one pass."""
    zero = F.struct(
        F.lit(0).alias("until"),
        F.array().cast("array<struct<id:int,last:int>>").alias("roots"),
    )

    def visit(acc: Column, x: Column) -> Column:
        hit = (x["id"] > acc["until"]) & F.coalesce(doomed(x), F.lit(False))
        root = F.struct(x["id"].alias("id"), x["last"].alias("last"))
        found = F.struct(x["last"].alias("until"), F.array_append(acc["roots"], root).alias("roots"))
        return F.when(hit, found).otherwise(acc)

    return F.aggregate(nodes, zero, visit, lambda acc: acc["roots"])


def without_ranges(page: Column, nodes: Column, roots: Column) -> Column:
    """``nodes`` minus the subtrees of ``roots``.

    ``page`` is the untouched array, where position equals id: the set
    difference runs on ids by hashing, then the survivors are looked up.
    """
    gone = F.flatten(F.transform(roots, lambda r: F.sequence(r["id"], r["last"])))
    kept = F.array_except(F.transform(nodes, lambda x: x["id"]), gone)
    return F.when(F.size(roots) == 0, nodes).otherwise(
        F.transform(kept, lambda i: F.get(page, i - 1))
    )
