"""Entity resolution: strong identifiers, aliases, and near names that are proposed, never merged."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import environment, kind_family, norm_name
from attesta.session import settle, shuffle_partitions

THRESHOLD = 0.7


def names(entities: DataFrame) -> DataFrame:
    """(id, kind, env, name_norm) of canonical entities; names without any usable character are left out."""
    return entities.where("canonical_id = id").select("id", "kind", environment(F.col("kind"), F.col("env")).alias("env"), norm_name(F.col("display_name")).alias("name_norm")).where("name_norm <> ''")


def strong_matches(mentions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(mention_id, id) by strong identifiers; the smallest entity id where several match.

    mentions: mention_id and an array ``identifiers`` of (authority, value); identifiers: id,
    authority, value, of which the first holder in order of id keeps each pair.
    """
    held = identifiers.groupBy("authority", "value").agg(F.min("id").alias("id"))
    named = mentions.select("mention_id", F.explode("identifiers").alias("i")).select("mention_id", F.lower(F.regexp_replace("i.authority", "[^A-Za-z0-9]+", "_")).alias("authority"), F.trim("i.value").alias("value"))
    return named.join(held, ["authority", "value"]).groupBy("mention_id").agg(F.min("id").alias("id"))


def alias_matches(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, id, rung) by equal normalised name.

    The environment must agree; a mention without one takes any, unless the name exists in
    several. A kind, where given, must be of the entity's family. Same kind is preferred,
    then the smaller id.
    """
    known = names(entities)
    asked = mentions.select("mention_id", F.col("kind").alias("asked_kind"), environment(F.col("kind"), F.col("env")).alias("asked_env"), norm_name(F.col("raw")).alias("name_norm")).where("name_norm <> ''")
    envs = known.groupBy("name_norm").agg(F.count_distinct(F.when(F.col("env") != "unknown", F.col("env"))).alias("real_envs"))
    pairs = asked.join(known, "name_norm").join(envs, "name_norm")
    fits = (F.col("asked_env") == F.col("env")) | ((F.col("asked_env") == "unknown") & (F.col("real_envs") <= 1))
    family = F.col("asked_kind").isNull() | (kind_family(F.col("asked_kind")) == kind_family(F.col("kind")))
    best = W.partitionBy("mention_id").orderBy(F.when(F.col("asked_kind") == F.col("kind"), 0).otherwise(1), "id")
    return pairs.where(fits & family).withColumn("nth", F.row_number().over(best)).where("nth = 1").select("mention_id", "id", F.lit("alias").alias("rung"))


#: Names that a task holds of either side, about.
BLOCK = 10000


def _alike(names: pa.Table, threshold: float) -> pa.Table:
    """(grp, name_a, name_b, shared, total) of one pair of blocks; names: grp, i, j, probe, name_norm, ordered.

    Of a name's n bigrams a partner at the threshold t shares at least o = t * n / (2 - t). So
    three of them (or o, if that is less) are among any n - o + 3, and only what shares these
    of the rarest is looked at in full.
    """
    rows = list(zip(names["probe"].to_pylist(), names["name_norm"].to_pylist()))
    grams = {name: {name[k : k + 2] for k in range(len(name) - 1)} for _, name in rows}
    held, asked = ([name for probe, name in rows if probe == side and grams[name]] for side in (False, True))
    found: list[tuple[str, str, int, int]] = []
    if held and asked:
        ids: dict[str, int] = {}
        lists = [np.array([ids.setdefault(g, len(ids)) for g in grams[name]], np.int32) for name in held]
        sizes = np.array([len(x) for x in lists])
        every, owner = np.concatenate(lists), np.repeat(np.arange(len(held)), sizes)
        df = np.bincount(every, minlength=len(ids))
        holders = np.split(owner[np.argsort(every, kind="stable")], np.cumsum(df)[:-1])
        marks = np.zeros((len(held), len(ids)), bool)
        marks[owner, every] = True
        ordered, low = names["ordered"][0].as_py(), threshold - 1e-6
        for name in asked:
            n = len(grams[name])
            least = max(1, math.ceil(low * n / (2 - low)))
            common = min(3, least)
            known = sorted((ids[g] for g in grams[name] if g in ids), key=df.__getitem__)
            first = max(0, n - least + common - (n - len(known)))  # bigrams that no held name has are the rarest
            if len(known) < least:
                continue
            near = np.flatnonzero(np.bincount(np.concatenate([holders[k] for k in known[:first]]), minlength=len(held)) >= common)
            shared = marks[near[:, None], np.array(known)].sum(1)
            fit = 2 * shared >= low * (n + sizes[near])
            for k, x in zip(near[fit].tolist(), shared[fit].tolist()):
                other = held[k]
                if ordered == 0 and other != name:
                    found.append((name, other, x, n + int(sizes[k])))
                elif ordered == 1 and name < other or ordered == 2 and name != other:
                    found.append((min(name, other), max(name, other), x, n + int(sizes[k])))
    a, b, shared, total = zip(*found) if found else ((), (), (), ())
    grp = names["grp"][0].as_py()
    return pa.table({"grp": pa.array([grp] * len(a), pa.string()), "name_a": pa.array(a, pa.string()), "name_b": pa.array(b, pa.string()), "shared": pa.array(shared, pa.int32()), "total": pa.array(total, pa.int32())})


def near_pairs(named: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(grp, name_a, name_b, score): different names of a group that are alike by Dice of bigrams, a < b.

    named: grp, name_norm and side, one row each; names that are both of side 0 or both of
    side 1 are only compared if the side is null; then a is of side 0 and b of side 1. Groups
    are cut into blocks of about ``BLOCK`` names, each pair of which is one piece of work, so no
    task holds a whole group; in a block names meet over an index of its bigrams.
    """
    count = lambda side: F.greatest(F.ceil(F.count_if(side) / BLOCK), F.lit(1)).cast("int")
    side = F.col("side")
    blocks = named.groupBy("grp").agg(count(side.isNull()).alias("all"), count(side == 0).alias("left"), count(side == 1).alias("right"))
    own = F.when(side.isNull(), F.col("all")).when(side == 0, F.col("left")).otherwise(F.col("right"))
    placed = named.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("name_norm"), own).cast("int"))

    def put(probe: bool, i: Column, j: Column, ordered: Column) -> Column:
        return F.struct(F.lit(probe).alias("probe"), i.alias("i"), j.alias("j"), ordered.cast("int").alias("ordered"))

    here, none = F.col("own"), F.array().cast("array<struct<probe:boolean,i:int,j:int,ordered:int>>")
    same = lambda x, y: F.when(x == y, 1).otherwise(2)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    within = F.concat(F.transform(F.sequence(here, F.col("all") - 1), lambda j: put(False, here, j, same(here, j))), F.transform(F.sequence(F.lit(0), here), lambda i: put(True, i, here, same(i, here))))
    across = F.when(side == 0, F.transform(upto(F.col("right")), lambda i: put(True, i, here, F.lit(0)))).when(side == 1, F.transform(upto(F.col("left")), lambda j: put(False, here, j, F.lit(0)))).otherwise(none)
    met = placed.select("grp", "name_norm", F.explode(F.when(side.isNull(), within).otherwise(across)).alias("at")).select("grp", "at.i", "at.j", "at.probe", "name_norm", "at.ordered")
    work = met.repartition(4 * shuffle_partitions(named.sparkSession), "grp", "i", "j", "ordered")
    pairs = work.groupBy("grp", "i", "j", "ordered").applyInArrow(lambda names: _alike(names, threshold), "grp string, name_a string, name_b string, shared int, total int")
    return pairs.select("grp", "name_a", "name_b", F.round(2.0 * F.col("shared") / F.col("total"), 6).alias("score")).where(F.col("score") >= threshold)


def near_names(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, kind, env, name_a, name_b, score): canonical entities of one kind and environment whose names are alike.

    Names are compared once each, whatever number of entities bears them: pairs are between
    distinct names (a < b by name) and rows carry the smallest id of each name.
    """
    distinct = names(entities).groupBy("kind", "env", "name_norm").agg(F.min("id").alias("id")).withColumn("grp", F.concat_ws("|", "kind", "env"))
    pairs = near_pairs(distinct.select("grp", "name_norm", F.lit(None).cast("int").alias("side")), threshold)
    ids = distinct.select("grp", "kind", "env", "name_norm", "id")
    return (
        pairs.join(ids.withColumnsRenamed({"name_norm": "name_a", "id": "a"}), ["grp", "name_a"])
        .join(ids.select("grp", "name_norm", "id").withColumnsRenamed({"name_norm": "name_b", "id": "b"}), ["grp", "name_b"])
        .select("a", "b", "kind", "env", "name_a", "name_b", "score")
    )


def ranked_matches(mentions: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, id, rung) by an alias: that of equal kind first, then of equal environment, then of the mention's scope, then the smaller id.

    aliases: id, name_norm, scope (null = everywhere); several rows of an entity count as one,
    scoped if any of them has the mention's scope. The kind, where given, must be of the
    entity's family, environments must agree or one be unknown. A mention without environment
    takes none where the fitting entities are in several real ones.
    """
    known = entities.where("canonical_id = id").select("id", "kind", environment(F.col("kind"), F.col("env")).alias("env"))
    asked = mentions.select("mention_id", "scope", F.col("kind").alias("asked_kind"), environment(F.col("kind"), F.col("env")).alias("asked_env"), norm_name(F.col("raw")).alias("name_norm")).where("name_norm <> ''")
    hits = asked.join(aliases.withColumnRenamed("scope", "alias_scope"), "name_norm").groupBy("mention_id", "asked_kind", "asked_env", "id").agg(F.bool_or(F.col("alias_scope").eqNullSafe(F.col("scope"))).alias("scoped"))
    fits = (F.col("asked_env") == F.col("env")) | (F.col("asked_env") == "unknown") | (F.col("env") == "unknown")
    family = F.col("asked_kind").isNull() | (kind_family(F.col("asked_kind")) == kind_family(F.col("kind")))
    rank = F.struct(F.coalesce(F.col("asked_kind") != F.col("kind"), F.lit(True)), F.col("asked_env") != F.col("env"), ~F.col("scoped"), F.col("id").alias("id"), F.col("scoped").alias("scoped"))
    best = hits.join(known, "id").where(fits & family).groupBy("mention_id", "asked_env").agg(F.min(rank).alias("best"), F.count_distinct(F.when(F.col("env") != "unknown", F.col("env"))).alias("envs"))
    sure = best.where((F.col("asked_env") != "unknown") | (F.col("envs") <= 1))
    return sure.select("mention_id", F.col("best.id").alias("id"), F.when(F.col("best.scoped"), "alias_scoped").otherwise("alias_global").alias("rung"))


def proposals(minted: DataFrame, entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(entity_id, id, score): the entity whose name is most like that of a minted one; proposed, never merged.

    minted: entity_id, kind, env, name_norm. The environment must be the same and the kind too
    if the minted one has one. Ties go to the smaller id. Equal names score 1.
    """
    known = names(entities)
    left = minted.select("entity_id", F.concat_ws("|", F.coalesce("kind", F.lit("*")), "env").alias("grp"), "name_norm").transform(settle, tidy=True)
    right = known.select("id", F.explode(F.array(F.concat_ws("|", "kind", "env"), F.concat_ws("|", F.lit("*"), "env"))).alias("grp"), "name_norm")
    both = settle(left.select("grp", "name_norm", F.lit(0).alias("side")).union(right.select("grp", "name_norm", F.lit(1).alias("side"))).distinct(), tidy=True)
    alike = settle(near_pairs(both, threshold), tidy=True).select("grp", F.col("name_a").alias("name_norm"), F.col("name_b").alias("other"), "score")
    same = left.join(right.select("grp", "name_norm").distinct(), ["grp", "name_norm"]).select("grp", "name_norm", F.col("name_norm").alias("other"), F.lit(1.0).alias("score")).distinct()
    borne = right.groupBy("grp", F.col("name_norm").alias("other")).agg(F.min("id").alias("id"))
    best = alike.union(same).join(borne, ["grp", "other"]).groupBy("grp", "name_norm").agg(F.min(F.struct(-F.col("score"), "id")).alias("b"))
    return left.join(best, ["grp", "name_norm"]).select("entity_id", F.col("b.id").alias("id"), (-F.col("b.col1")).alias("score"))


def different_routes(candidates: DataFrame, signatures: DataFrame) -> DataFrame:
    """(id, a, b) of open proposals between endpoints of which some signatures differ, to be marked distinct, a < b.

    candidates: id, subject, object, verdict (null = open); signatures: id, path, method.
    """
    first, second = (signatures.select(F.col("id").alias(end), F.struct("path", "method").alias(name)) for end, name in (("subject", "one"), ("object", "two")))
    met = candidates.where("verdict is null").join(first, "subject").join(second, "object").where(~F.col("one").eqNullSafe(F.col("two")))
    return met.select("id", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()


def mintable(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """(entity_id, kind, env, name_norm, mentions): what unresolved mentions would mint.

    One entity for each name, environment and kind family; its id is a digest of these, so
    any batch order mints the same. The kind is that of the earliest mention.
    """
    left = mentions.join(resolved.select("mention_id").distinct(), "mention_id", "left_anti")
    shaped = left.select("mention_id", "kind", kind_family(F.coalesce("kind", F.lit("thing"))).alias("family"), environment(F.col("kind"), F.col("env")).alias("env"), norm_name(F.col("raw")).alias("name_norm")).where("name_norm <> ''")
    key = F.sha2(F.concat_ws("|", "name_norm", "env", "family"), 256)
    return shaped.groupBy(key.alias("entity_id"), "env", "name_norm").agg(F.min_by("kind", "mention_id").alias("kind"), F.count(F.lit(1)).alias("mentions"))


def repairs(entities: DataFrame, degrees: DataFrame) -> DataFrame:
    """(from_id, into_id): equal names of one kind to merge, unless they are in several real environments.

    The kept one has most edges, then is settled, then has the smallest id.
    """
    known = entities.where("canonical_id = id").select("id", "kind", "env", "provisional", norm_name(F.col("display_name")).alias("name_norm")).where("name_norm <> ''")
    ranked = known.join(degrees, "id", "left").withColumn("rank", F.struct(-F.coalesce("degree", F.lit(0)), F.coalesce("provisional", F.lit(False)), F.col("id").alias("id")))
    kept = ranked.groupBy("kind", "name_norm").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct(F.when(F.col("env") != "unknown", F.col("env"))).alias("envs"), F.min("rank").alias("keeper")
    ).where("size > 1 and envs <= 1").select("kind", "name_norm", F.col("keeper.id").alias("into_id"))
    return known.select("id", "kind", "name_norm").join(kept, ["kind", "name_norm"]).where("id <> into_id").select(F.col("id").alias("from_id"), "into_id")


def barred_merges(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, reason) of open proposals that must not be merged: found distinct before, or in two real environments.

    candidates: id, subject, object, verdict (null = open). Pairs count in either direction.
    """
    pair = candidates.select("id", "subject", "object", "verdict", F.least("subject", "object").alias("x"), F.greatest("subject", "object").alias("y"))
    distinct = pair.where("verdict = 'distinct'").select("x", "y").distinct().withColumn("known", F.lit(True))
    env = entities.select("id", environment(F.col("kind"), F.col("env")).alias("env"))
    sides = (
        pair.where("verdict is null").join(distinct, ["x", "y"], "left")
        .join(env.withColumnsRenamed({"id": "subject", "env": "env_a"}), "subject", "left").join(env.withColumnsRenamed({"id": "object", "env": "env_b"}), "object", "left")
    )
    split = (F.col("env_a") != F.col("env_b")) & (F.col("env_a") != "unknown") & (F.col("env_b") != "unknown")
    return sides.select("id", F.when(F.col("known"), "distinct").when(split, "environments").alias("reason")).where("reason is not null")
