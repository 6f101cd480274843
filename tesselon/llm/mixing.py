"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a domain - language - source tree. At each node it is
shared among the children by weight; a child never gets more than its rows can
give in ``max_epochs`` passes, and what it can't use goes to its siblings. A
node's own supply is the sum of its children's, so a shortage leaves a node, and
reaches its ancestors' other children, only when all siblings are used up. Each
leaf then takes whole epochs and the token-prefix of one more, in an order seeded
for each epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

LEVELS = ("domain", "language", "source")
#: Rows that share a step of the prefix search, about.
STEP_ROWS = 4096
BROADCAST_LEAVES = 10_000


def chars_as_tokens(text: Column) -> Column:
    """A token for every four characters or part of them."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4)).cast("long")


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (weight, supply, pool) with ``budget``, the share of the pool.

    The children whose supply is least for their weight fill up first; one is
    full when the pool that is left, dealt by weight, would exceed its supply.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("weight"), *[c for c in LEVELS if c in nodes.columns])
    upto, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    ranked = nodes.filter("weight > 0").withColumn("__before", F.coalesce(F.sum("supply").over(upto), F.lit(0.0))).withColumn("__onward", F.sum("weight").over(onward))
    full = F.col("supply") * F.col("__onward") <= (F.col("pool") - F.col("__before")) * F.col("weight")
    ranked = ranked.withColumn("__full", full)
    used = F.coalesce(F.sum(F.when(F.col("__full"), F.col("supply"))).over(whole), F.lit(0.0))
    rest = F.sum(F.when(~F.col("__full"), F.col("weight"))).over(whole)
    budget = F.when(F.col("__full"), F.col("supply")).otherwise((F.col("pool") - used) * F.col("weight") / rest)
    return ranked.withColumn("budget", budget).drop("__before", "__onward", "__full")


def weight_of(level: str, weights: dict[str, float]) -> Column:
    """The weight of a node by its name; 1 for a name that isn't listed."""
    found = F.lit(1.0)
    for name, w in weights.items():
        found = F.when(F.col(level) == name, F.lit(float(w))).otherwise(found)
    return found


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """``leaves`` (domain, language, source, rows, tokens) with the tokens to take, ``take``."""
    at = leaves.withColumn("supply", (F.col("tokens") * max_epochs).cast("double"))
    domains = at.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("tokens").cast("double").alias("tokens"))
    everything = Window.partitionBy(F.lit(1))
    domains = domains.withColumn("pool", total * F.sum("tokens").over(everything)).withColumn("weight", weight_of("domain", weights.get("domain", {})))
    domains = share(domains.withColumn("__root", F.lit(1)), ["__root"]).select("domain", F.col("budget").alias("pool"))
    languages = at.groupBy("domain", "language").agg(F.sum("supply").alias("supply")).join(domains, "domain").withColumn("weight", weight_of("language", weights.get("language", {})))
    languages = share(languages, ["domain"]).select("domain", "language", F.col("budget").alias("pool"))
    found = at.join(languages, ["domain", "language"]).withColumn("weight", weight_of("source", weights.get("source", {})))
    return share(found, ["domain", "language"]).select(*LEVELS, "rows", "tokens", F.floor("budget").cast("long").alias("take"))


def order_key(id_col: Column, seed: int, epoch: Column) -> Column:
    """The place of a row in an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def mix(
    df: DataFrame,
    domain: Column,
    language: Column,
    source: Column,
    weights: dict[str, dict[str, float]],
    share_of_tokens: float,
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    text_col: str = "text",
    out: str = "mix",
) -> DataFrame:
    """The chosen rows with their columns and a struct ``out`` (epoch, domain, language, source, tokens).

    The budget is ``share_of_tokens`` of the corpus. A row is repeated once for
    each epoch that takes it, ``max_epochs`` times at most; with one epoch no row
    is repeated. A prefix ends before the first row that would exceed the leaf's
    budget. A row without tokens costs nothing: it is in every whole epoch, and in
    the prefix if it comes before the prefix ends; a leaf without any tokens is
    taken once. Null names count as the empty name, null text as no tokens; rows
    with equal ids (nulls too) are taken or left together; an empty table gives an
    empty result. Other columns pass through, but one named as ``out`` is
    replaced; names beginning with ``__`` are reserved.
    """
    ident = F.col(f"`{id_col}`")
    tokens = chars_as_tokens(F.col(f"`{text_col}`")) if tokens is None else tokens
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(f"__{n}") for n, c in zip(LEVELS, (domain, language, source), strict=True)]
    named.append(F.coalesce(tokens, F.lit(0)).cast("long").alias("__tokens"))
    leaf = [f"__{n}" for n in LEVELS]

    narrow = cut(df.select(ident.alias("__id"), *named))
    leaves = narrow.groupBy(*[F.col(c).alias(n) for c, n in zip(leaf, LEVELS, strict=True)]).agg(F.count("*").alias("rows"), F.sum("__tokens").alias("tokens"))
    plan = budgets(leaves, F.lit(float(share_of_tokens)), weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("take") / F.col("tokens")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("__whole", whole).withColumn("__rest", F.col("take") - F.col("__whole") * F.col("tokens"))
    plan = cut(plan.select(*[F.col(n).alias(c) for c, n in zip(leaf, LEVELS, strict=True)], "__whole", "__rest", F.ceil(F.col("rows") / STEP_ROWS).cast("long").alias("__steps")))
    few = plan.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda x: x)

    key = order_key(F.col("__id"), seed, F.col("__whole"))
    step = F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("double") * F.col("__steps") / F.lit(2.0**32)).cast("long")
    placed = narrow.join(small(plan), leaf).withColumn("__order", key).withColumn("__step", step)
    steps = placed.groupBy(*leaf, "__step").agg(F.sum("__tokens").alias("__sum"), F.first("__rest").alias("__rest"))
    along = Window.partitionBy(*leaf).orderBy("__step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("__cum", F.sum("__sum").over(along)).filter("__cum > __rest")
    edge = steps.groupBy(*leaf).agg(F.min("__step").alias("__edge"), F.min_by(F.col("__cum") - F.col("__sum"), "__step").alias("__base"))
    within = Window.partitionBy(*leaf).orderBy("__order").rangeBetween(Window.unboundedPreceding, 0)
    last = placed.join(small(edge), leaf).filter("__step = __edge").withColumn("__cum", F.col("__base") + F.sum("__tokens").over(within))
    last = last.filter("__cum <= __rest").groupBy(*leaf).agg(F.max("__order").alias("__last"))
    limits = cut(plan.join(edge, leaf, "left").join(last, leaf, "left").drop("__base", "__rest"))

    rows = df.select("*", *named).join(small(limits), leaf)
    rows = rows.withColumn("__order", order_key(ident, seed, F.col("__whole"))).withColumn("__step", step)
    # Where no step exceeds the rest (a leaf without tokens), all of it is the prefix.
    taken = F.col("__edge").isNull() | (F.col("__step") < F.col("__edge")) | ((F.col("__step") == F.col("__edge")) & (F.col("__order") <= F.col("__last")))
    epochs = F.least(F.col("__whole") + F.coalesce(taken, F.lit(False)).cast("long"), F.lit(max_epochs).cast("long"))
    rows = rows.withColumn("__epochs", epochs).filter("__epochs > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__epochs") - 1)))
    mixed = F.struct(F.col("__epoch").alias("epoch"), *[F.col(f"__{n}").alias(n) for n in LEVELS], F.col("__tokens").alias("tokens"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != out], mixed.alias(out))
