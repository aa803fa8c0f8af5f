"""Consolidating pairwise matches: connected components by hash-to-min.

Every vertex holds a cluster, kept as rows (vertex, member) so that no cluster is ever
collected into one task. In each round a vertex sends its cluster to the smallest member
and that smallest member to all the others, until no row changes. At the end the smallest
vertex of a component holds all of it and every other vertex holds only that smallest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attesta.session import forget, settle


def hex_id(value: Column) -> Column:
    """The 16 bytes of an id's 32 hexadecimal digits; null for anything else."""
    digits = F.regexp_replace(value, "[^0-9A-Fa-f]", "")
    return F.when(F.length(digits) == 32, F.unhex(digits))


def _settled(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """``pairs`` as a table, and a fingerprint of its rows that is taken while it is written."""
    mixed, seen = F.xxhash64("v", "u"), Observation()
    table = settle(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(mixed, 20)).alias("sum"), F.bit_xor(mixed).alias("xor")))
    return table, tuple(seen.get.values())


def _rows(pairs: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """(v, u) for each named pair of columns of each row."""
    return pairs.select(F.explode(F.array(*(F.struct(F.col(v).alias("v"), F.col(u).alias("u")) for v, u in ends))).alias("p")).select("p.v", "p.u").distinct()


def hash_to_min(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(member, root) for every vertex of ``edges`` (columns a, b); root is the component's minimum.

    Rows with a null end are ignored, self-links keep their vertex as its own component,
    repeated and reversed rows make no difference, and no edges give no rows. Rounds grow
    with the logarithm of the longest chain; each is written as a table, and the one before
    is deleted. The rows of a component's smallest vertex may be a third of all; the join
    with the minima then has one row a vertex on its other side, which is the shape that
    adaptive execution splits without loss.
    """
    ends = edges.where("a is not null and b is not null").select("a", "b")
    pairs, before = _settled(_rows(ends, ("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")))
    for _ in range(max_rounds):
        least = pairs.groupBy("v").agg(F.min("u").alias("m"))
        after, now = _settled(_rows(pairs.join(least, "v"), ("m", "u"), ("u", "m")))
        forget(pairs)
        pairs = after
        if now == before:
            return pairs.groupBy(F.col("v").alias("member")).agg(F.min("u").alias("root"))
        before = now
    raise RuntimeError(f"the components weren't stable after {max_rounds} rounds")


def match_edges(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b) of the confirmed match rows and of the pointers between different entities."""
    confirmed = F.lower(F.regexp_replace("resolution", r"(?U)^\s+|\s+$", "")) == "merged"
    merged = candidates.where(confirmed).select(hex_id(F.col("from_id")).alias("a"), hex_id(F.col("into_id")).alias("b"))
    pointers = entities.select(hex_id(F.col("id")).alias("a"), hex_id(F.col("canonical_id")).alias("b"))
    return merged.union(pointers).where("a <> b")


def entity_groups(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, group_id of each entity in a group of two or more.

    Ids that are in no entity row link nothing. Ids come back as ``entities.id`` has them;
    group_id is the smallest such id of the group by string.
    """
    known = entities.select(hex_id(F.col("id")).alias("member"), F.col("id").alias("entity_id")).where("member is not null").distinct().transform(settle)
    edges = match_edges(candidates, entities)
    for end in ("a", "b"):
        edges = edges.join(known.select(F.col("member").alias(end)).distinct(), end, "left_semi")
    named = hash_to_min(edges).join(known, "member")
    names = named.groupBy("root").agg(F.min("entity_id").alias("group_id"))
    return named.join(names, "root").select("entity_id", "group_id").distinct()
