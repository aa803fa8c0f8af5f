"""Claims as of an instant: liveness, trust, functional values and closed scopes.

Rows are only appended. What closes an assertion is another row (its closure), so any read
takes the instant ``at`` and gives the answer of that time, late rows included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.trust import weight


def instant(at: str | Column) -> Column:
    return F.to_timestamp(F.lit(at)) if isinstance(at, str) else at


def live(assertions: DataFrame, at: str | Column) -> DataFrame:
    """Assertions in force at ``at``, with their weight; all four bounds are half-open.

    Bounds that the input doesn't have are open. Null bounds are open too; a null
    created_at is never in force.
    """
    moment = instant(at)
    kept = assertions.where(F.col("created_at") <= moment)
    for column, before in (("expired_at", False), ("valid_to", False), ("valid_from", True)):
        if column in assertions.columns:
            kept = kept.where(F.col(column).isNull() | ((F.col(column) <= moment) if before else (F.col(column) > moment)))
    return kept.withColumn("weight", weight(F.col("method"), F.col("created_at"), F.col("confidence"), moment))


def edges_at(assertions: DataFrame, at: str | Column) -> DataFrame:
    """One row a proposition with live support: its trust and counts.

    Trust is the best support, raised by a tenth for each further method (a fifth at most),
    less the best refutation, and never negative. Propositions with refutations only vanish.
    """
    grouped = live(assertions, at).groupBy("proposition_id").agg(
        *[F.first(c).alias(c) for c in ("subject", "predicate", "object", "object_literal")],
        F.max(F.when(F.col("polarity"), F.col("weight"))).alias("support"),
        F.max(F.when(~F.col("polarity"), F.col("weight"))).alias("refute"),
        F.count_if("polarity").alias("support_count"),
        F.count_if(~F.col("polarity")).alias("refute_count"),
        F.size(F.collect_set(F.when(F.col("polarity"), F.col("method")))).alias("methods"),
    )
    bonus = F.least(1.0 + 0.1 * F.greatest(F.col("methods") - 1, F.lit(0)), F.lit(1.2))
    trust = F.greatest(F.lit(0.0), F.col("support") * bonus - F.coalesce("refute", F.lit(0.0)))
    return grouped.where("support is not null").select("proposition_id", "subject", "predicate", "object", "object_literal", trust.alias("trust"), "support_count", "refute_count", "methods")


def single_edges_at(assertions: DataFrame, at: str | Column) -> DataFrame:
    """(proposition_id, subject, predicate, object, object_literal, trust) as ``edges_at`` gives them, for claims of which each is one assertion: nothing is gathered."""
    alone = live(assertions, at).where(F.col("polarity") & F.col("weight").isNotNull())
    return alone.select("proposition_id", "subject", "predicate", "object", "object_literal", F.greatest(F.lit(0.0), F.col("weight")).alias("trust"))


def asof_series(assertions: DataFrame, instants: list[str]) -> DataFrame:
    """Edges, refuted edges and mean trust at each of several instants, in one pass over the claims."""
    moments = F.explode(F.array(*[F.to_timestamp(F.lit(t)) for t in instants]))
    at = assertions.withColumn("at", moments)
    tagged = live(at, F.col("at")).withColumn("proposition_id", F.concat_ws("@", F.col("at").cast("string"), "proposition_id"))
    grouped = tagged.groupBy("at", "proposition_id").agg(
        F.max(F.when(F.col("polarity"), F.col("weight"))).alias("support"), F.max(F.when(~F.col("polarity"), F.col("weight"))).alias("refute"),
        F.size(F.collect_set(F.when(F.col("polarity"), F.col("method")))).alias("methods"),
    ).where("support is not null")
    trust = F.greatest(F.lit(0.0), F.col("support") * F.least(1.0 + 0.1 * F.greatest(F.col("methods") - 1, F.lit(0)), F.lit(1.2)) - F.coalesce("refute", F.lit(0.0)))
    return grouped.groupBy("at").agg(F.count(F.lit(1)).alias("edges"), F.count_if(trust == 0).alias("refuted"), F.round(F.avg(trust), 6).alias("mean_trust"))


def supersede(assertions: DataFrame) -> DataFrame:
    """(assertion columns, valid_to): functional values, closed by the next different one.

    Each positive row of a (subject, predicate) is closed when the first later row states
    another proposition. Rows of equal time count as one moment and close nothing among
    themselves. Runs of the same proposition are collapsed first, so a value stated again
    later opens anew.
    """
    keys = ["subject", "predicate", "created_at", "proposition_id"]
    moment = W.partitionBy("subject", "predicate").orderBy("created_at", "proposition_id")
    stated = assertions.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))  # a hot subject's repeats are one row before they meet
    changed = stated.withColumn("before", F.lag("proposition_id").over(moment)).withColumn("turn", F.sum(F.when(F.col("before").eqNullSafe(F.col("proposition_id")), 0).otherwise(1)).over(moment))
    turns = changed.groupBy("subject", "predicate", "turn").agg(F.min("created_at").alias("began"))
    after = W.partitionBy("subject", "predicate").orderBy("began").rangeBetween(1, W.unboundedFollowing)
    ends = turns.withColumn("began", F.unix_micros("began")).withColumn("until", F.min("began").over(after)).select("subject", "predicate", "turn", "until")
    closed = assertions.join(changed.join(ends, ["subject", "predicate", "turn"]).select(*keys, "until"), keys)
    return closed.select(*assertions.columns, F.when(F.col("polarity"), F.timestamp_micros("until")).alias("valid_to"))


def current_values(assertions: DataFrame, at: str) -> DataFrame:
    """The value of each functional (subject, predicate) at ``at``."""
    held = supersede(assertions.where(F.col("created_at") <= instant(at)))
    return live(held, at).groupBy("subject", "predicate", F.coalesce("object", "object_literal").alias("value")).agg(F.max("created_at").alias("since"), F.count(F.lit(1)).alias("claims"))


def sweep(assertions: DataFrame, scope_key: str, run_start: str) -> DataFrame:
    """Closures of a scope's open assertions from before a run: (proposition_id, created_at, closed_at).

    A run has just written the whole scope anew, so what it didn't write is over. Rows of
    the very moment of the run's start stay open.
    """
    begun = instant(run_start)
    return assertions.where((F.col("scope_key") == scope_key) & (F.col("created_at") < begun)).select("proposition_id", "created_at", begun.alias("closed_at"))


def swept_edges(assertions: DataFrame, scope_key: str, run_start: str) -> DataFrame:
    """Propositions that lost all their open support by a sweep."""
    closed = assertions.where((F.col("scope_key") == scope_key) & (F.col("created_at") < instant(run_start)) & F.col("polarity"))
    left = assertions.where(F.col("polarity") & ~(F.col("scope_key").eqNullSafe(F.lit(scope_key)) & (F.col("created_at") < instant(run_start))))
    return closed.select("proposition_id").distinct().join(left.select("proposition_id").distinct(), "proposition_id", "left_anti")
