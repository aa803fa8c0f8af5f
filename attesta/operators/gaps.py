"""What the graph doesn't know: nine kinds of gaps, scored, and the questions worth asking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.operators.graph import degree
from attesta.session import settle
from attesta.sources.vocabulary import predicate_rows

# The base score of each kind of gap.
BASE = {
    "name_collision": 0.95, "dangling_endpoint": 0.90, "homeless_project": 0.80, "no_access_info": 0.60, "unknown_technology": 0.55,
    "unprovisioned_infra": 0.50, "undescribed_concept": 0.45, "unidentified_entity": 0.40, "orphan_entity": 0.30,
}
#: A fixed value: how much more a gap with a suggested answer is worth.
SUGGESTED = 1.15
TECHNOLOGY = tuple(name for name, family, _ in predicate_rows() if family == "technology")
PROJECTS, STORES = ("client", "service", "iac_module"), ("datastore", "cache", "queue")


def gaps(entities: DataFrame, edges: DataFrame, proposals: DataFrame, identified: DataFrame, joins: DataFrame | None = None) -> DataFrame:
    """(kind, id, name, entity_kind, connectivity, suggested): one row a gap.

    entities: id, canonical_id, kind, display_name, provisional; edges: canonical; proposals:
    subject, object, verdict (null = open); identified: ids with a strong identifier; joins
    (called, served): routes that may be the same. A join is the suggested answer to a
    dangling endpoint, and a collision of two names that one covers isn't asked about. The nine
    rules are semi- and anti-joins on the ids that one pass over the edges lists by role.
    """
    live = entities.where("canonical_id = id").select("id", F.col("kind").alias("entity_kind"), F.col("display_name").alias("name"), "provisional")
    known = settle(live.join(degree(edges), "id", "left").withColumn("connectivity", F.coalesce("degree", F.lit(0))).drop("degree"))
    roles = edges.select(F.col("subject").alias("id"), F.concat(F.lit("s:"), F.col("predicate")).alias("role")).union(
        edges.where("object is not null").select(F.col("object").alias("id"), F.concat(F.lit("o:"), F.col("predicate")).alias("role")))
    wanted = ["o:calls", "o:exposes_endpoint", "s:lives_in_repo", "s:connect_via", "s:provisioned_by", "s:note", *(f"s:{p}" for p in TECHNOLOGY)]
    has = roles.where(F.col("role").isin(*wanted)).groupBy("id").agg(F.collect_set("role").alias("roles"))
    seen = known.join(has, "id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>"))).join(identified.select("id").distinct().withColumn("identified", F.lit(True)), "id", "left")

    def lacks(*roles: str) -> Column:
        return ~F.arrays_overlap("roles", F.array(*map(F.lit, roles)))

    kind = F.col("entity_kind")
    rules = {
        "dangling_endpoint": (kind == "endpoint") & F.array_contains("roles", "o:calls") & lacks("o:exposes_endpoint"),
        "homeless_project": kind.isin(*PROJECTS) & lacks("s:lives_in_repo"),
        "no_access_info": kind.isin(*STORES) & lacks("s:connect_via"),
        "unknown_technology": kind.isin("client", "service") & lacks(*(f"s:{p}" for p in TECHNOLOGY)),
        "unprovisioned_infra": kind.isin(*STORES, "cloud_resource") & lacks("s:provisioned_by"),
        "undescribed_concept": kind.isin("capability", "data_concept") & lacks("s:note"),
        "unidentified_entity": F.col("provisional") & (F.col("connectivity") >= 2) & F.col("identified").isNull(),
        "orphan_entity": (F.col("connectivity") == 0) & (kind != "technology"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    single = seen.select(F.explode(found).alias("kind"), "id", "name", "entity_kind", "connectivity")
    if joins is None:
        joins = edges.select(F.col("subject").alias("called"), F.col("object").alias("served")).where("false")
    answered = joins.select(F.col("called").alias("id")).distinct().withColumn("answered", F.lit(True))
    covered = joins.select(F.least("called", "served").alias("x"), F.greatest("called", "served").alias("y")).distinct()
    pair = proposals.select("subject", "object", "verdict", F.least("subject", "object").alias("x"), F.greatest("subject", "object").alias("y"))
    apart = pair.where("verdict = 'distinct'").select("x", "y").distinct()
    collisions = pair.where("verdict is null").join(apart, ["x", "y"], "left_anti").join(covered, ["x", "y"], "left_anti").select(F.col("subject").alias("id"), "object").distinct()
    every = single.unionByName(collisions.join(known, "id").select(F.lit("name_collision").alias("kind"), "id", "name", "entity_kind", "connectivity"))
    suggested = (F.col("kind") == "dangling_endpoint") & F.col("answered").isNotNull()
    return every.join(answered, "id", "left").withColumn("suggested", suggested).drop("answered")


def scored(found: DataFrame) -> DataFrame:
    """``found`` with its score: the base, up to a third more with the entity's connectivity, and more where an answer can be suggested."""
    base = reduce(lambda c, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(c), BASE.items(), F.lit(0.0))
    return found.withColumn("score", F.round(base * (1 + F.least("connectivity", F.lit(8)) * 0.04) * F.when(F.col("suggested"), SUGGESTED).otherwise(1.0), 3))


def askable(found: DataFrame, near: DataFrame, budget: int = 2, least: float = 0.5) -> DataFrame:
    """The ``budget`` best gaps to ask about, one an entity, those near the topic (ids) first."""
    topic = near.select("id").distinct().withColumn("near", F.lit(True))
    worth = found.where(F.col("score") >= least).join(topic, "id", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    first = W.partitionBy("id").orderBy(F.desc("score"), "kind")
    order = [F.desc("near"), F.desc("score"), "kind", "id"]
    return worth.withColumn("nth", F.row_number().over(first)).where("nth = 1").orderBy(*order).limit(budget).drop("nth")
