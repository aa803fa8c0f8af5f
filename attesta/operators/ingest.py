"""Taking claims in: vocabulary, qualifiers, identity and refusals, set by set instead of row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import has_secret, norm_name, norm_predicate, split_qualifiers
from attesta.operators import resolve
from attesta.session import settle
from attesta.sources import vocabulary


def resolve_predicates(raw: DataFrame) -> DataFrame:
    """(raw, candidate, predicate, unmapped, hits) of each distinct raw predicate (column raw).

    Unknown ones are kept as written and counted, never refused. The vocabulary is small and
    fixed, so both its tables are broadcast.
    """
    spark = raw.sparkSession
    counted = raw.groupBy("raw").agg(F.count(F.lit(1)).alias("hits")).withColumn("candidate", norm_predicate(F.col("raw"))).where("candidate <> ''")
    exact = vocabulary.predicates(spark).select(F.col("name").alias("candidate"), F.col("name").alias("exact"))
    alias = vocabulary.aliases(spark).select(F.col("raw").alias("candidate"), "maps_to")
    joined = counted.join(F.broadcast(exact), "candidate", "left").join(F.broadcast(alias), "candidate", "left")
    known = F.coalesce("exact", "maps_to")
    return joined.select("raw", "candidate", F.coalesce(known, "candidate").alias("predicate"), known.isNull().alias("unmapped"), "hits")


def entries(qualifiers: Column) -> Column:
    """A map's entries as "k=v" in order of the keys; empty for a null map."""
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(qualifiers)), lambda e: F.concat_ws("=", e["key"], F.trim(e["value"]))), ",")
    return F.coalesce(joined, F.lit(""))


def fingerprint(subject: Column, predicate: Column, obj: Column, literal: Column, identifying: Column) -> Column:
    """Digest of what makes a claim itself: ends, predicate and identifying qualifiers in order of their keys."""
    target = F.when(obj.isNotNull(), F.concat(F.lit("e|"), obj)).otherwise(F.concat(F.lit("l|"), literal))
    return F.sha2(F.concat_ws("\n", F.concat(F.lit("e|"), subject), predicate, target, entries(identifying)), 256)


def propositions(claims: DataFrame) -> DataFrame:
    """(fingerprint, assertions, first_said) of distinct claims; ``claims`` may have a map ``qualifiers``."""
    given = F.col("qualifiers") if "qualifiers" in claims.columns else F.create_map().cast("map<string,string>")
    identifying, _ = split_qualifiers(given)
    key = fingerprint(F.col("subject"), F.col("predicate"), F.col("object"), F.col("object_literal"), identifying)
    return claims.groupBy(key.alias("fingerprint")).agg(F.count(F.lit(1)).alias("assertions"), F.min("created_at").alias("first_said"))


def descriptive_claims(rows: DataFrame, key: str, qualifiers: str) -> DataFrame:
    """(about, predicate, value): one claim about the claim for each descriptive qualifier."""
    _, descriptive = split_qualifiers(F.col(qualifiers))
    return rows.select(F.col(key).alias("about"), F.explode(descriptive).alias("predicate", "value")).withColumn("predicate", norm_predicate(F.col("predicate")))


def accepted(rows: DataFrame, literal: str) -> DataFrame:
    """``rows`` with ``error``: null for accepted ones, the reason for those whose literal holds a credential.

    The check comes before anything is written, so a refused row leaves no trace.
    """
    return rows.withColumn("error", F.when(has_secret(F.col(literal)), "literal appears to contain a credential"))


def unseen(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose idempotency key isn't stored yet, one a key."""
    return batch.dropDuplicates([key]).join(store.select(key).distinct(), key, "left_anti")


def batch(observations: DataFrame, entities: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Observations taken in as one staged batch: refused, replayed, resolved, named and fingerprinted set by set.

    observations: key, subject, predicate, object (names as written), polarity, method,
    created_at; entities as for ``resolve.alias_matches``; store: key of what was taken in
    before. Gives (key, error, fingerprint, subject_id, predicate, object_id, unmapped, minted,
    polarity, method, created_at): rows with an error stop there, rows whose key is stored or
    repeats are left out, names that no entity bears mint one id for each name, and predicates
    that the vocabulary doesn't know stay as written. Null subjects, predicates and objects are errors.
    """
    rows = unseen(observations, store, "key") if store is not None else observations.dropDuplicates(["key"])
    missing = F.when(F.col("subject").isNull() | F.col("predicate").isNull() | F.col("object").isNull(), "subject, predicate or object is missing")
    checked = settle(accepted(rows, "object").withColumn("error", F.coalesce("error", missing)))
    good = checked.where("error is null")
    predicates = resolve_predicates(good.select(F.col("predicate").alias("raw"))).select(F.col("raw").alias("predicate"), F.col("predicate").alias("resolved"), "unmapped")
    spelt = good.select(F.explode(F.array("subject", "object")).alias("raw")).distinct().select(F.xxhash64("raw").alias("mention_id"), "raw", *(F.lit(None).cast("string").alias(c) for c in ("kind", "env")))
    known = resolve.alias_matches(spelt, entities).select("mention_id", "id")
    fresh = F.concat(F.lit("new:"), F.sha2(norm_name(F.col("raw")), 256))
    named = settle(spelt.join(known, "mention_id", "left").select("raw", F.coalesce("id", fresh).alias("id"), F.col("id").isNull().alias("minted")))
    ends = {side: named.select(F.col("raw").alias(side), F.col("id").alias(f"{side}_id"), F.col("minted").alias(f"{side}_minted")) for side in ("subject", "object")}
    joined = good.join(predicates, "predicate").join(ends["subject"], "subject").join(ends["object"], "object")
    key = fingerprint(F.col("subject_id"), F.col("resolved"), F.col("object_id"), F.lit(None).cast("string"), F.lit(None).cast("map<string,string>"))
    taken = joined.select("key", "error", key.alias("fingerprint"), "subject_id", F.col("resolved").alias("predicate"), "object_id", "unmapped", (F.col("subject_minted") | F.col("object_minted")).alias("minted"), "polarity", "method", "created_at")
    return taken.unionByName(checked.where("error is not null").select("key", "error", "polarity", "method", "created_at"), allowMissingColumns=True)
