"""Usage and quality reports, in full or with names replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.sources.vocabulary import predicates

SALT = "attesta/report"
# Tools that read and tools that write.
READING = ("ask", "lookup_entity", "find_context", "load_context", "find_similar", "pending_questions")
WRITING = ("record_observations", "record_statement", "answer_question", "write_context", "scan_repository")


def usage_by_tool(activity: DataFrame) -> DataFrame:
    return activity.groupBy("source", "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
        F.date_format(F.min("at_ts"), "yyyy-MM-dd HH:mm:ss").alias("first_call"), F.date_format(F.max("at_ts"), "yyyy-MM-dd HH:mm:ss").alias("last_call"))


def calls_per_day(activity: DataFrame) -> DataFrame:
    return activity.groupBy(F.date_format("at_ts", "yyyy-MM-dd").alias("day"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"))


def read_write_ratio(activity: DataFrame) -> DataFrame:
    """(agent, reads, writes, ratio); no ratio where nothing was written."""
    reads, writes = F.count_if(F.col("tool").isin(*READING)), F.count_if(F.col("tool").isin(*WRITING))
    return activity.groupBy("agent").agg(reads.alias("reads"), writes.alias("writes"), F.round(F.when(writes > 0, reads / writes), 3).alias("ratio"))


def predicate_families(claims: DataFrame) -> DataFrame:
    """(family, predicate, propositions, assertions); predicates outside the vocabulary are of family other."""
    family = F.broadcast(predicates(claims.sparkSession).select(F.col("name").alias("predicate"), "family"))
    counted = claims.groupBy("predicate").agg(F.count_distinct("proposition_id").alias("propositions"), F.count(F.lit(1)).alias("assertions"))
    return counted.join(family, "predicate", "left").select(F.coalesce("family", F.lit("other")).alias("family"), "predicate", "propositions", "assertions")


def assertion_quality(claims: DataFrame) -> DataFrame:
    """Per method: assertions, refutations, claims, mean confidence and propositions with one method only."""
    methods = claims.groupBy("proposition_id").agg(F.count_distinct("method").alias("methods"))
    return claims.join(methods, "proposition_id").groupBy("method").agg(
        F.count(F.lit(1)).alias("assertions"), F.count_if(~F.col("polarity")).alias("refutations"), F.count_distinct("proposition_id").alias("propositions"),
        F.count_distinct(F.when(F.col("methods") == 1, F.col("proposition_id"))).alias("uncorroborated"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
