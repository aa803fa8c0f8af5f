"""Claims read from ordinary tables: one row an assertion, the shape all operators work on.

assertion: proposition_id, subject, predicate, object, object_literal, polarity, method,
confidence, created_at, scope_key. Claims about things have an ``object``, claims with a
plain value an ``object_literal``. Nothing is ever updated; closures are rows of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.tables import keyed, table

COLUMNS = ("subject", "predicate", "object", "object_literal", "polarity", "method", "confidence", "created_at", "scope_key")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def claims(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as assertions; what isn't given is null, polarity true."""
    none = F.lit(None).cast("string")
    given = {"object": none, "object_literal": none, "polarity": F.lit(True), "confidence": F.lit(None).cast("double"), "scope_key": none} | columns
    shaped = df.select(*[given[c].alias(c) for c in COLUMNS])
    return shaped.withColumn("proposition_id", F.concat_ws("|", "subject", "predicate", F.coalesce("object", "object_literal")))


def event_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Users call endpoints; the kind of event says by what method, errors speak against."""
    kind = F.col("event_type")
    method = F.when(kind == "click", "code_derived").when(kind == "view", "llm_inferred").when(kind == "purchase", "human").when(kind == "signup", "telemetry").otherwise("verifier")
    endpoint = F.concat(F.lit("ep:"), (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 10).cast("string"))
    return claims(
        table(spark, folder, "events"), subject=_id("user", "user_id"), predicate=F.lit("calls"), object=endpoint, polarity=kind != "error", method=method,
        confidence=F.least(F.col("value") / 500, F.lit(1.0)), created_at=F.col("ts").cast("timestamp"), scope_key=F.concat(F.lit("run:"), F.date_format("ts", "yyyy-MM-dd")),
    )


def ownership_claims(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's latest order says which priority desk owns it: a functional claim."""
    return claims(
        table(spark, folder, "orders"), subject=_id("cust", "o_custkey"), predicate=F.lit("owned_by"), object_literal=F.col("o_orderpriority"), method=F.lit("human"), created_at=F.col("o_orderdate").cast("timestamp"),
    )


def supply_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Customers call suppliers, suppliers read from parts, parts belong to brands, all live in nations."""
    return reduce(DataFrame.unionByName, supply_parts(spark, folder))


def supply_parts(spark: SparkSession, folder: str, once: bool = False) -> list[DataFrame]:
    """The claims of ``supply_claims`` in three tables: those calling, those reading, the others.

    With ``once`` a claim that several rows of a table make is one assertion.
    """
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    code, start = F.lit("code_derived"), F.to_timestamp(F.lit("1992-01-01 00:00:00"))
    calls = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.min("l_shipdate").alias("first"))
    reads = line.groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("first"))
    ends = {"part": ("p_partkey", "p_brand"), "supplier": ("s_suppkey", "s_nationkey"), "customer": ("c_custkey", "c_nationkey"), "nation": ("n_nationkey", "n_regionkey")}
    part, supplier, customer, nation = (table(spark, folder, t).select(*columns).distinct() if once else table(spark, folder, t) for t, columns in ends.items())
    linked = [
        claims(calls, subject=_id("cust", "o_custkey"), predicate=F.lit("calls"), object=_id("supp", "l_suppkey"), method=code, created_at=F.col("first").cast("timestamp")),
        claims(reads, subject=_id("supp", "l_suppkey"), predicate=F.lit("reads_from"), object=_id("part", "l_partkey"), method=code, created_at=F.col("first").cast("timestamp")),
        claims(part, subject=_id("part", "p_partkey"), predicate=F.lit("part_of"), object=_id("brand", "p_brand"), method=code, created_at=start),
        claims(supplier, subject=_id("supp", "s_suppkey"), predicate=F.lit("lives_in_repo"), object=_id("nation", "s_nationkey"), method=code, created_at=start),
        claims(customer, subject=_id("cust", "c_custkey"), predicate=F.lit("lives_in_repo"), object=_id("nation", "c_nationkey"), method=code, created_at=start),
        claims(nation, subject=_id("nation", "n_nationkey"), predicate=F.lit("part_of"), object=_id("region", "n_regionkey"), method=code, created_at=start),
    ]
    return [*linked[:2], reduce(DataFrame.unionByName, linked[2:])]


def entity_id(value: Column) -> Column:
    """An id as the entity table writes it, from any way of writing its hexadecimal digits."""
    digits = F.lower(F.regexp_replace(value, "[^0-9A-Fa-f]", ""))
    dashed = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(F.length(digits) == 32, dashed)


def catalogue_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Links between catalogued entities: each reviewed pair, as the predicate its target's kind calls for.

    A pair found distinct speaks against the link; the review's method and score weigh it.
    """
    pairs = keyed(spark, folder, "merge_candidate", "id", "from_id", "into_id", "score", "method", "created_at", "resolution").select(
        "id", entity_id(F.col("from_id")).alias("subject"), entity_id(F.col("into_id")).alias("object"), "score", "method", "created_at", F.lower(F.regexp_replace("resolution", r"^\s+|\s+$", "")).alias("verdict")
    ).where("subject is not null and object is not null and subject <> object")
    kinds = keyed(spark, folder, "entity", "id", "kind").select(F.col("id").alias("object"), "kind")
    kind, odd = F.col("kind"), F.col("id") % 2 == 1
    predicate = (
        F.when((kind == "endpoint") & odd, "calls").when(kind == "endpoint", "exposes_endpoint").when(kind == "repo", "lives_in_repo").when(kind == "team", "owned_by")
        .when(kind == "iac_module", "provisioned_by").when(kind.isin("datastore", "cache", "queue"), "reads_from").when(kind == "package", "depends_on_package").otherwise("depends_on")
    )
    method = F.when(F.col("method") == "human", "human").when(F.col("method") == "trigram", "telemetry").when(F.col("method") == "dice", "llm_inferred").otherwise("other")
    return claims(
        pairs.join(kinds, "object"), subject=F.col("subject"), predicate=predicate, object=F.col("object"), polarity=F.coalesce(F.col("verdict") != "distinct", F.lit(True)), method=method,
        confidence=F.col("score"), created_at=F.col("created_at"), scope_key=F.concat(F.lit("day:"), F.date_format("created_at", "yyyy-MM-dd")),
    )
