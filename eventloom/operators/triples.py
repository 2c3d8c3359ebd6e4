"""Flattening of triple tables (s, p, o, lang) into records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.ranking import global_running
from eventloom.session import spread, stage


def property_usage(triples: DataFrame, more_than: int = 0) -> DataFrame:
    """Triples and distinct subjects per predicate."""
    used = triples.groupBy("p").agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"))
    return used.where(F.col("triples") > more_than)


def class_usage(triples: DataFrame, type_property: str, more_than: int = 0) -> DataFrame:
    """Subjects per class."""
    used = triples.where(F.col("p") == type_property).groupBy(F.col("o").alias("class")).agg(F.count("*").alias("count"))
    return used.where(F.col("count") > more_than)


def _of_type(triples: DataFrame, type_property: str, cls: str) -> Column:
    return (F.col("p") == type_property) & (F.col("o") == cls)


def flatten_aggregated(
    triples: DataFrame, type_property: str, cls: str | list[str], required: list[str], optional: list[str], separator: str = "| "
) -> DataFrame:
    """One row per entity of a class: smallest value, distinct count and list per property.

    Only needed predicates are read; duplicates go before grouping, and all properties come
    from one aggregate. Both take as many tasks as there is input for.
    """
    classes = [cls] if isinstance(cls, str) else cls
    columns = required + optional
    needed = triples.where(F.col("p").isin(columns) | ((F.col("p") == type_property) & F.col("o").isin(classes)))
    distinct = spread(spread(needed.select("s", "p", "o"), "s", "p", "o").distinct(), "s")

    def value(name: str) -> Column:
        return F.when(F.col("p") == name, F.col("o"))

    figures = []
    for name in columns:
        figures += [
            F.min(value(name)).alias(name),
            F.count(value(name)).alias(f"{name}Count"),
            F.nullif(F.array_join(F.sort_array(F.collect_list(value(name))), separator), F.lit("")).alias(f"{name}s"),
        ]
    typed = F.count_if((F.col("p") == type_property) & F.col("o").isin(classes)).alias("_typed")
    kept = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in required], F.col("_typed") > 0)
    return distinct.groupBy("s").agg(typed, *figures).where(kept).drop("_typed")


def value_pages(triples: DataFrame, properties: list[str], size: int = 1000) -> DataFrame:
    """The distinct values of each subject and property in order, as pages of at most ``size``:
    (s, p, page, values), pages counted from 0.

    For subjects with more values than a cell should hold. Values are put in order by ranges
    that any number of tasks share, and numbered by the sums of the ranges before, so no task holds
    more than its range and no row more than a page.
    """
    distinct = triples.where(F.col("p").isin(properties)).select("s", "p", "o").distinct()
    numbered = global_running(distinct, [F.asc("s"), F.asc("p"), F.asc("o")]).select("s", "p", "o", "rowNumber")
    first = numbered.groupBy("s", "p").agg(F.min("rowNumber").alias("first"))
    page = F.floor((F.col("rowNumber") - F.col("first")) / size).cast("long")
    placed = numbered.join(first, ["s", "p"]).select("s", "p", page.alias("page"), "o")
    return placed.groupBy("s", "p", "page").agg(F.sort_array(F.collect_list("o")).alias("values"))


def flatten_figures(triples: DataFrame, type_property: str, cls: str | list[str], required: list[str], optional: list[str]) -> DataFrame:
    """As :func:`flatten_aggregated` without the lists, which :func:`value_pages` has: smallest
    value and distinct count of each property."""
    classes = [cls] if isinstance(cls, str) else cls
    columns = required + optional
    typed = (F.col("p") == type_property) & F.col("o").isin(classes)
    # counted by property first, so that no subject's values meet in one task
    distinct = spread(triples.where(F.col("p").isin(columns) | typed).select("s", "p", "o"), "s", "p", "o").distinct()
    counted = distinct.groupBy("s", "p").agg(F.min("o").alias("least"), F.count("*").alias("n"), F.max(typed).alias("typed"))
    figures = [
        f
        for name in columns
        for f in (F.min(F.when(F.col("p") == name, F.col("least"))).alias(name), F.sum(F.when(F.col("p") == name, F.col("n")).otherwise(0)).alias(f"{name}Count"))
    ]
    kept = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in required], F.col("_typed"))
    return counted.groupBy("s").agg(F.max("typed").alias("_typed"), *figures).where(kept).drop("_typed")


def values(triples: DataFrame, prop: str, name: str, lang: str | None = None) -> DataFrame:
    """(s, name) rows of a property, in one language if given."""
    found = triples.where(F.col("p") == prop)
    if lang is not None:
        found = found.where(F.col("lang") == lang)
    return found.select("s", F.col("o").alias(name))


def inverse_values(triples: DataFrame, prop: str, name: str) -> DataFrame:
    """(s, name) rows of subjects that point at s."""
    return triples.where(F.col("p") == prop).select(F.col("o").alias("s"), F.col("s").alias(name))


def flatten_rows(
    entities: DataFrame, required: list[DataFrame], optional: list[DataFrame]
) -> DataFrame:
    """Entities with their properties as distinct rows, one per combination of values."""
    rows = reduce(lambda a, b: a.join(b, "s"), required, entities)
    return reduce(lambda a, b: a.join(b, "s", "left"), optional, rows).distinct()


def entities_of(triples: DataFrame, type_property: str, cls: str) -> DataFrame:
    return triples.where(_of_type(triples, type_property, cls)).select("s").distinct()


def series_flatten(triples: DataFrame, entities: DataFrame, short: str, label: str, ids: list[str], lang: str) -> DataFrame:
    """Series with their short name, or else label, and external ids."""
    rows = flatten_rows(
        entities,
        [values(triples, label, "label", lang)],
        [values(triples, short, "shortName"), *[values(triples, i, i) for i in ids]],
    )
    return rows.select("s", F.coalesce("shortName", "label").alias("acronym"), "label", *ids)


def iri_group(records: DataFrame, iri: str, prefix: str, series_format: str) -> DataFrame:
    """Records per series named in their IRI, with year span and the IRI of the series."""
    found = records.where(F.col(iri).startswith(prefix)).select(
        F.substring_index(F.replace(F.col(iri), F.lit(prefix), F.lit("")), "/", 1).alias("conf"), "year"
    )
    before, after = series_format.split("{value}")
    return found.groupBy("conf").agg(
        F.count("*").alias("count"), F.min("year").alias("minYear"), F.max("year").alias("maxYear")
    ).withColumn("series", F.concat(F.lit(before), "conf", F.lit(after)))


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """All (child, ancestor) pairs reachable over edges; cycles end by themselves.

    Every round extends only the pairs found in the round before. Rounds are written to the
    staging folder, which keeps plans short, survives lost executors, and lets the planner
    broadcast the edges only while their files are small.
    """
    links = stage(edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).distinct(), "edges")
    known = frontier = links.select("child", F.col("parent").alias("ancestor"))
    step = links.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    while True:
        reached = frontier.join(step, "ancestor").select("child", F.col("next").alias("ancestor")).distinct()
        frontier = stage(reached.join(known, ["child", "ancestor"], "left_anti"), "closure")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def descendants(edges: DataFrame, target: str) -> DataFrame:
    """Everything below a target, found downwards so that no other branch is visited."""
    links = stage(edges.select("child", "parent").distinct(), "edges")
    known = frontier = links.where(F.col("parent") == target).select("child")
    while True:
        reached = links.join(frontier.select(F.col("child").alias("parent")), "parent", "left_semi").select("child").distinct()
        frontier = stage(reached.join(known, "child", "left_anti"), "below")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


class Reach:
    """Labels by which "below X" is a range: no pair of nodes is ever written.

    ``nodes`` has each node's place (``low``) in a walk of a spanning forest and the last place
    below it (``high``), so the tree below a node is a range of places. ``extra`` has the edges that
    are not in the forest, by places: what they add to "below X" is found by following them.
    """

    def __init__(self, nodes: DataFrame, extra: DataFrame):
        self.nodes, self.extra = nodes, extra


def reach_labels(edges: DataFrame, child: str = "child", parent: str = "parent") -> Reach:
    """Label the nodes of a graph, which may have cycles and nodes with several parents.

    The forest is grown from the nodes without parents, one level a round; what only cycles lead
    to is grown from the least node left. Sizes are then added up from the last level to the
    first, and places dealt out from the first to the last. Rounds are as many as the graph is deep, each
    one over the rows of its level.
    """
    links = edges.select(F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent"))
    links = stage(links.where("child <> parent").distinct(), "edges")
    everyone = stage(links.select(F.col("child").alias("node")).unionByName(links.select(F.col("parent").alias("node"))).distinct(), "nodes")
    null = F.lit(None).cast("string")
    frontier = stage(everyone.join(links.select(F.col("child").alias("node")), "node", "left_anti").select("node", null.alias("up")), "level")
    levels: list[DataFrame] = []
    placed = None
    while True:
        if frontier.isEmpty():
            left = everyone if placed is None else everyone.join(placed, "node", "left_anti")
            least = left.agg(F.min("node")).first()[0]
            if least is None:
                break
            frontier = stage(left.where(F.col("node") == least).select("node", null.alias("up")), "level")
        levels.append(frontier)
        placed = frontier.select("node") if placed is None else placed.unionByName(frontier.select("node"))
        step = links.join(frontier.select(F.col("node").alias("parent")), "parent").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"))
        frontier = stage(step.join(placed, "node", "left_anti"), "level")
    if not levels:
        nodes = everyone.select("node", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
        return Reach(nodes, links.select(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))

    # nodes below each node, itself included, from the last level up
    sized: list[DataFrame] = []
    below = None
    for level in reversed(levels):
        size = F.lit(1).cast("long")
        found = level.withColumn("size", size) if below is None else level.join(below, "node", "left").select("node", "up", (size + F.coalesce("inner", F.lit(0))).alias("size"))
        found = stage(found, "sizes")
        sized.append(found)
        # a level may also begin anew, with a root that is below none
        below = found.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("inner"))
    sized.reverse()

    # places: a node's children follow it, each behind the nodes of those before it
    roots = None
    for found in sized:
        own = found.where("up IS NULL")
        roots = own if roots is None else roots.unionByName(own)
    first = global_running(roots, [F.asc("node")], F.col("size")).select("node", F.col("before").alias("low"), (F.col("before") + F.col("size") - 1).alias("high"))
    first = stage(first, "places")
    parts, above = [], None
    for found in sized:
        own = first.join(found.where("up IS NULL").select("node"), "node", "left_semi")
        if above is not None:
            ranked = global_running(found.where("up IS NOT NULL").select("node", "up", "size"), [F.asc("up"), F.asc("node")], F.col("size"))
            start = ranked.groupBy("up").agg(F.min("before").alias("start"))
            inner = ranked.join(start, "up").join(above.select(F.col("node").alias("up"), F.col("low").alias("_low")), "up")
            low = F.col("_low") + 1 + F.col("before") - F.col("start")
            own = own.unionByName(inner.select("node", low.alias("low"), (low + F.col("size") - 1).alias("high")))
        above = stage(own.select("node", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")), "places")
        parts.append(above)
    nodes = stage(reduce(lambda a, b: a.unionByName(b), parts), "reach-nodes")
    tree = reduce(lambda a, b: a.unionByName(b), levels).where("up IS NOT NULL").select(F.col("node").alias("child"), F.col("up").alias("parent"))
    others = links.join(tree, ["child", "parent"], "left_anti")
    lower = nodes.select(F.col("node").alias("child"), "low", "high")
    upper = nodes.select(F.col("node").alias("parent"), F.col("low").alias("to"))
    extra = others.join(lower, "child").join(upper, "parent").select("to", "low", "high")
    return Reach(nodes, stage(extra.distinct(), "reach-extra"))


def ranges_below(reach: Reach, target: str) -> list[tuple[int, int]]:
    """The places below a node, or of it, as ranges that do not overlap: one, and those that other edges add.

    A round finds the other edges that lead into the ranges known so far, and adds up what lies
    below them, as long as that is new. The driver holds ranges, never nodes; ranges inside
    others are left out.
    """
    own = reach.nodes.where(F.col("node") == target).select("low", "high").first()
    if own is None:
        return []
    known = [(own["low"], own["high"])]
    while True:
        inside = F.lit(False)
        for low, high in known:
            inside = inside | F.col("to").between(low, high)
        covered = F.lit(False)
        for low, high in known:
            covered = covered | ((F.col("low") >= low) & (F.col("high") <= high))
        # of the new ranges only those that no other one holds, and neighbours as one
        new = reach.extra.where(inside & ~covered).select("low", "high").distinct()
        outer = new.groupBy("low").agg(F.max("high").alias("high")).orderBy("low").collect()
        if not outer:
            return known
        merged: list[tuple[int, int]] = []
        for low, high in sorted([*known, *((r["low"], r["high"]) for r in outer)]):
            if merged and low <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        known = merged


def instances_of(types: DataFrame, subclasses: DataFrame, target: str) -> DataFrame:
    """Subjects whose type is the target class or, over any number of steps, below it."""
    reach = reach_labels(subclasses)
    inside = F.lit(False)
    for low, high in ranges_below(reach, target):
        inside = inside | F.col("low").between(low, high)
    classes = reach.nodes.where(inside).select(F.col("node").alias("o"))
    return types.where(F.col("o") == target).select("s").unionByName(types.join(classes, "o", "left_semi").select("s")).distinct()


def property_count(triples: DataFrame, type_property: str, cls: str, properties: list[str]) -> DataFrame:
    """Entities of a class that have each property.

    Class and property are brought together per subject by one aggregate, not a join.
    """
    needed = triples.where(F.col("p").isin(properties) | _of_type(triples, type_property, cls))
    per_subject = needed.groupBy("s").agg(
        F.max(_of_type(triples, type_property, cls)).alias("typed"),
        *[F.max(F.col("p") == name).alias(f"_{i}") for i, name in enumerate(properties)],
    ).where("typed")
    cells = [F.struct(F.lit(n).alias("p"), F.count_if(F.col(f"_{i}")).alias("items")) for i, n in enumerate(properties)]
    return per_subject.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def in_list(triples: DataFrame, prop: str, wanted: list[str], optional: dict[str, str]) -> DataFrame:
    """Entities whose property is in a list, with optional properties."""
    found = triples.where((F.col("p") == prop) & F.col("o").isin(wanted)).select("s", F.col("o").alias(prop))
    return flatten_rows(found, [], [values(triples, p, name) for p, name in optional.items()])
