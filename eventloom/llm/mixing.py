"""Mixing sources to target weights, by budgets passed down a tree of domain, language and source.

A node gives its budget to its children by their weights. A child gets no more than it can
use (its tokens times the allowed epochs); what it leaves goes to its siblings first, and to
the siblings of its ancestors only where a whole subtree is used up. Each leaf then takes
whole epochs, and of one more epoch, in seeded order, the documents that fit the rest.
Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.session import stage

#: Buckets of the seeded order of a leaf, and parts of a bucket.
_BUCKETS = 64


@dataclass(frozen=True)
class Level:
    """One level of the tree: its column, the SQL for a row's node, and the weights of nodes."""

    name: str
    node: str
    weights: dict[str, int] = field(default_factory=dict)
    other: int = 1

    def weight(self) -> str:
        cases = " ".join(f"WHEN '{node}' THEN {weight}" for node, weight in self.weights.items())
        return f"CASE {self.name} {cases} ELSE {self.other} END" if cases else str(self.other)


@dataclass(frozen=True)
class Mixture:
    """``share`` of all tokens is the budget; a document is used at most ``epochs`` times."""

    levels: tuple[Level, ...]
    share: tuple[int, int] = (1, 1)
    epochs: int = 2
    seed: int = 17

    @property
    def names(self) -> list[str]:
        return [level.name for level in self.levels]


MIXTURE = Mixture(
    (
        Level(
            "domain",
            "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'web'"
            " WHEN source IN ('src8', 'src9', 'src10', 'src11', 'src12', 'src13') THEN 'reference' ELSE 'forum' END",
            {"web": 5, "reference": 3, "forum": 2},
        ),
        Level("lang", "coalesce(lang, 'und')", {"en": 5, "de": 2, "fr": 2}),
        Level("source", "coalesce(source, 'none')", {"src0": 2}),
    )
)


def with_leaves(documents: DataFrame, mixture: Mixture, carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` (as ``__name``), ``doc_id``, ``__row``, the nodes of each row, and its tokens (words).

    A null text has no tokens. A row without language or source has the node its level names.
    ``__row`` stands for the row in the seeded order: its ``doc_id``, or without one a hash of its text.
    """
    kept = [F.col(c).alias(f"__{c}") for c in carry]
    nodes = [F.expr(level.node).alias(level.name) for level in mixture.levels]
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    row = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return documents.select(*kept, "doc_id", row.alias("__row"), *nodes, words.cast("long").alias("n_tokens"))


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """Leaves (nodes, ``tokens``) with the tokens each may give, ``budget``, rounded down.

    The tables here have one row a node, whatever the number of documents. A node with weight
    0 gets nothing, and its share counts as not usable.
    """
    weights = [F.expr(level.weight()).cast("long").alias(f"w_{level.name}") for level in mixture.levels]
    usable = F.when(F.least(*[F.col(f"w_{n}") for n in mixture.names], F.lit(1)) > 0, F.col("tokens") * mixture.epochs).otherwise(F.lit(0).cast("long"))
    tree = leaves.select("*", *weights).withColumn("cap", usable)
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {mixture.share[0]} div {mixture.share[1]}")).first()[0]  # one number
    given, parents = None, []
    for level in mixture.levels:
        path = [*parents, level.name]
        nodes = tree.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w_{level.name}").alias("w")).where("w > 0 AND cap > 0")
        nodes = nodes.join(given, parents) if parents else nodes.withColumn("budget", F.lit(total).cast("long"))
        given = _fill(nodes, parents, level.name).select(*path, "budget")
        parents = path
    return tree.join(given, mixture.names, "left").select(*mixture.names, "tokens", F.coalesce("budget", F.lit(0).cast("long")).alias("budget"))


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Divide the parents' ``budget`` by weight ``w``, up to ``cap`` each.

    In the order of cap per weight the children that get their whole cap come first: those
    for which the rest of the budget, divided by the rest of the weights, is enough.
    """
    order = W.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), name)
    everyone = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sorted_nodes = nodes.withColumn("before", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap"))
    sorted_nodes = sorted_nodes.withColumn("rest_w", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    full = F.col("cap") * F.col("rest_w") <= (F.col("budget") - F.col("before")) * F.col("w")
    marked = sorted_nodes.withColumn("full", full)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everyone), F.lit(0).cast("long"))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everyone)
    marked = marked.withColumn("used", used).withColumn("open_w", open_w)
    return marked.withColumn("budget", F.expr("CASE WHEN full THEN cap ELSE ((budget - used) * w) div open_w END"))


def _order(mixture: Mixture, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mixture.seed)), epoch.cast("string"), F.col("__row")))


def _bucket(order: Column, part: int) -> Column:
    """The first twelve bits of the order: 64 buckets (part 1) of 64 parts each (part 2)."""
    bits = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    return F.floor(bits / _BUCKETS) if part == 1 else bits % _BUCKETS


def cut(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """For each leaf: its whole epochs, and the last place (``upto``) of its partial epoch.

    ``rows`` is the written table of ``with_leaves``. The seeded order is cut by sums of 64
    buckets, then of 64 parts of the bucket that holds the cut, so that only the rows of one
    part in 4096 of a leaf are put in order. Rows with equal places stay or go together.
    """
    names = mixture.names
    leaves = stage(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    shares = stage(
        budgets(leaves, mixture).where("tokens > 0").select(*names, F.expr("budget div tokens").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest")),
        "budgets",
    )
    placed = rows.join(shares.where("rest > 0"), names).withColumn("place", _order(mixture, F.col("epochs")))
    placed = placed.withColumn("b1", _bucket(F.col("place"), 1)).withColumn("b2", _bucket(F.col("place"), 2))
    first = stage(_crossing(placed, names, "b1"), "first-buckets")
    inner = placed.drop("rest").join(first, [*names, "b1"])
    second = stage(_crossing(inner, names, "b2"), "second-buckets")
    last = inner.drop("rest").join(second, [*names, "b2"])
    running = W.partitionBy(*names).orderBy("place", "doc_id", "n_tokens").rangeBetween(W.unboundedPreceding, W.currentRow)
    place = F.struct("place", "doc_id", "n_tokens")
    fits = last.withColumn("sum", F.sum("n_tokens").over(running)).where("sum <= rest").groupBy(*names).agg(F.max(place).alias("upto"))
    # where nothing of the last part fits, the cut lies before it
    borders = second.select(*names, "b2").join(first.select(*names, "b1"), names)
    cuts = shares.select(*names, "epochs", (F.col("rest") > 0).alias("partial")).join(borders, names, "left").join(fits, names, "left")
    return stage(cuts, "cuts")


def _crossing(placed: DataFrame, names: list[str], bucket: str) -> DataFrame:
    """The bucket in which the running sum exceeds ``rest``, and what is left of ``rest`` there."""
    sums = placed.groupBy(*names, bucket).agg(F.sum("n_tokens").alias("tokens"), F.max("rest").alias("rest"))
    upto = F.sum("tokens").over(W.partitionBy(*names).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow))
    over = sums.withColumn("upto", upto).where("upto > rest")
    reach = over.groupBy(*names).agg(F.min(F.struct(bucket, F.expr("rest - (upto - tokens)").alias("rest"))).alias("found"))
    return reach.select(*names, f"found.{bucket}", "found.rest")


def select(rows: DataFrame, cuts: DataFrame, mixture: Mixture) -> DataFrame:
    """Every row once for each epoch (from 0) that takes it."""
    names = mixture.names
    place = F.struct(_order(mixture, F.col("epochs")).alias("place"), "doc_id", "n_tokens")
    joined = rows.join(cuts, names).withColumn("__place", place)
    b1, b2 = _bucket(F.col("__place.place"), 1), _bucket(F.col("__place.place"), 2)
    inside = (b1 < F.col("b1")) | ((b1 == F.col("b1")) & ((b2 < F.col("b2")) | ((b2 == F.col("b2")) & (F.col("__place") <= F.col("upto")))))
    taken = F.col("epochs") + F.when(F.col("partial") & F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    epochs = F.when(taken > 0, F.sequence(F.lit(0).cast("long"), taken - 1))
    return joined.withColumn("epoch", F.explode(epochs)).drop("epochs", "partial", "b1", "b2", "upto", "__place", "__row")


def mix(documents: DataFrame, mixture: Mixture = MIXTURE) -> DataFrame:
    """``doc_id``, its nodes, ``n_tokens`` and ``epoch`` (from 0), once for each use of a document.

    Rows that repeat a ``doc_id`` are used each, at one place of the order; rows without one have the
    place of their text. An empty table gives no rows.
    """
    rows = stage(with_leaves(documents, mixture), "leaf-rows")
    return select(rows, cut(rows, mixture), mixture)


def mixed_documents(documents: DataFrame, columns: tuple[str, ...], mixture: Mixture = MIXTURE) -> DataFrame:
    """The rows of ``documents``, repeated as the mixture uses them; the texts are not shuffled."""
    rows = stage(with_leaves(documents, mixture), "leaf-rows")
    used = select(with_leaves(documents, mixture, columns), cut(rows, mixture), mixture)
    return used.select(*[F.col(f"__{c}").alias(c) for c in columns])


def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    used = mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return used.select("doc_id", "domain", "lang", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"))


def oracle(mixture: Mixture = MIXTURE) -> str:
    """The same selection in DuckDB SQL, with one running sum a leaf."""
    names = mixture.names
    text = [
        "WITH rows AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS row_key, "
        + ", ".join(f"{level.node} AS {level.name}" for level in mixture.levels)
        + r", len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)",
        f"leaves AS (SELECT {', '.join(names)}, sum(n_tokens)::HUGEINT AS tokens FROM rows GROUP BY ALL)",
        f"given0 AS (SELECT sum(tokens) * {mixture.share[0]} // {mixture.share[1]} AS budget FROM leaves)",
    ]
    for depth, level in enumerate(mixture.levels, 1):
        path, parents = ", ".join(names[:depth]), names[: depth - 1]
        by = f"PARTITION BY {', '.join(parents)}" if parents else ""
        using = f"JOIN given{depth - 1} USING ({', '.join(parents)})" if parents else f"CROSS JOIN given{depth - 1}"
        order = f"{by} ORDER BY cap::DOUBLE / w, {level.name}"
        text += [
            f"nodes{depth} AS (SELECT {path}, sum(tokens) * {mixture.epochs} AS cap, max({level.weight()}) AS w FROM leaves GROUP BY {path} HAVING sum(tokens) > 0)",
            f"sorted{depth} AS (SELECT *, sum(cap) OVER ({order} ROWS UNBOUNDED PRECEDING) - cap AS before,"
            f" sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM nodes{depth} {using})",
            f"marked{depth} AS (SELECT *, cap * rest_w <= (budget - before) * w AS whole FROM sorted{depth})",
            f"given{depth} AS (SELECT {path}, CASE WHEN whole THEN cap ELSE (budget - coalesce(sum(cap) FILTER (whole) OVER ({by}), 0)) * w"
            f" // sum(w) FILTER (NOT whole) OVER ({by}) END AS budget FROM marked{depth})",
        ]
    key = f"md5('{mixture.seed}:' || epochs || ':' || row_key)"
    leaf = ", ".join(names)
    text += [
        f"shares AS (SELECT {leaf}, (budget // tokens)::BIGINT AS epochs, budget % tokens AS rest FROM leaves JOIN given{len(names)} USING ({leaf}))",
        f"running AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY {key}, doc_id, n_tokens RANGE UNBOUNDED PRECEDING) AS upto FROM rows JOIN shares USING ({leaf}))",
        f"taken AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS uses FROM running)",
    ]
    return ",\n".join(text) + f"\nSELECT doc_id, {leaf}, n_tokens, unnest(range(0, uses)) AS epoch FROM taken"
