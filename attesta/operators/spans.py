"""Evidence spans: what was cited, and whether it still stands where it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import lines_digest, norm_lines
from attesta.session import settle


def digests(evidence: DataFrame) -> DataFrame:
    """``evidence`` with its span's digest and number of normalised lines; null and blank spans have neither."""
    lines = norm_lines(F.col("span_text"))
    return evidence.withColumn("digest", lines_digest(lines)).withColumn("norm_lines", F.when(F.size(lines) > 0, F.size(lines)))


def _file() -> Column:
    """16 bytes that stand for a path in a repository (or in none)."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("in "), "repo"), F.lit("")), F.lit("\n"), "path")))


def _in_repo(df: DataFrame) -> DataFrame:
    return df if "repo" in df.columns else df.withColumn("repo", F.lit(None).cast("string"))


def latest_files(evidence: DataFrame) -> DataFrame:
    """(repo, path, content, starts): the newest text known of each file and the line it starts at.

    A file is a path in a repository; those cited without a repository are files of their own.
    Rows delivered twice make no difference, so they needn't be removed before.
    """
    cited = evidence.where("path is not null and span_text is not null and size(lines) = 2")
    newest = cited.groupBy("repo", "path").agg(F.max_by(F.struct("span_text", "lines"), F.struct("cited_at", "evidence_id")).alias("v"))
    return newest.select("repo", "path", F.col("v.span_text").alias("content"), F.element_at("v.lines", 1).alias("starts"))


def check(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(evidence_id, state, moved_from, moved_to, healed) of each anchor against the current text of
    its file, the same path in the same repository (or, for both, in none).

    anchors: evidence_id, repo, path, lines, digest, norm_lines, enclosing_symbol; files: repo,
    path, content, starts. gone: no such file; unchecked: no digest was taken; ok: the cited
    lines are equal but for formatting; shifted: equal lines stand elsewhere (the first such
    place is given, and ``healed`` are the lines to cite from now on); changed: they don't, but
    the enclosing symbol does; else gone. Each file is read once, whatever the number of its
    anchors: it gives the digests of its windows of the lengths asked for, and which of the
    symbols asked for it holds; anchors meet these by equal digests and symbols.
    """
    anchors, files = _in_repo(anchors), _in_repo(files)
    cited = settle(anchors.select(
        "evidence_id", _file().alias("file"), F.unhex("digest").alias("digest"), F.col("norm_lines").alias("n"), F.element_at("lines", 1).alias("lo"), F.element_at("lines", 2).alias("hi"), F.col("enclosing_symbol").alias("symbol")))
    asked = cited.groupBy("file").agg(F.collect_set("n").alias("sizes"), F.collect_set("symbol").alias("symbols"))
    numbered = F.transform(norm_lines(F.col("content")), lambda x: F.struct((x["line"] + F.col("starts") - 1).alias("line"), x["text"].alias("text")))
    read = files.select(_file().alias("file"), "content", "starts").join(asked, "file").withColumn("text", numbered)

    def windows(n: Column) -> Column:
        starts = F.when(F.size("text") >= n, F.sequence(F.lit(1), F.size("text") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            n.alias("n"), F.unhex(lines_digest(F.slice("text", i, n))).alias("digest"), i.alias("place"), F.get("text", i - 2)["line"].alias("before"), F.get("text", i - 1)["line"].alias("first"),
            F.get("text", i + n - 2)["line"].alias("last"), F.get("text", i + n - 1)["line"].alias("after")))

    each = settle(read.select("file", F.filter("symbols", lambda s: F.contains("content", s)).alias("held"), F.flatten(F.transform("sizes", windows)).alias("windows")))
    there = each.select("file", F.explode("windows").alias("w")).select("file", "w.*")
    inside = (F.col("first") >= F.col("lo")) & (F.col("last") <= F.col("hi")) & F.coalesce(F.col("before") < F.col("lo"), F.lit(True)) & F.coalesce(F.col("after") > F.col("hi"), F.lit(True))
    placed = cited.where("digest is not null").join(there, ["file", "n", "digest"]).groupBy("evidence_id").agg(F.bool_or(inside).alias("here"), F.min(F.struct("place", "first", "last")).alias("at"))
    joined = cited.select("evidence_id", "file", F.col("digest").isNotNull().alias("taken"), "symbol").join(each.select("file", "held"), "file", "left").select(
        "evidence_id", "taken", F.col("held").isNotNull().alias("known"), F.coalesce(F.array_contains("held", F.col("symbol")), F.lit(False)).alias("symbol")).join(placed, "evidence_id", "left")
    state = (
        F.when(~F.col("known"), "gone").when(~F.col("taken"), "unchecked").when(F.coalesce("here", F.lit(False)), "ok")
        .when(F.col("at").isNotNull(), "shifted").when(F.col("symbol"), "changed").otherwise("gone")
    )
    moved = F.col("state") == "shifted"
    return joined.withColumn("state", state).select(
        "evidence_id", "state", F.when(moved, F.col("at.first")).alias("moved_from"), F.when(moved, F.col("at.last")).alias("moved_to"), F.when(moved, F.array("at.first", "at.last")).alias("healed"))


def queue(checked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(evidence_id, state, place): what to look at again, vanished spans before changed ones, newest first."""
    due = checked.where(F.col("state").isin("changed", "gone")).join(evidence.select("evidence_id", "repo", "cited_at"), "evidence_id")
    order = W.partitionBy("repo").orderBy(F.when(F.col("state") == "gone", 0).otherwise(1), F.desc_nulls_last("cited_at"), "evidence_id")
    return due.select("evidence_id", "repo", "state", F.row_number().over(order).alias("place"))
