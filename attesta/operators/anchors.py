"""Where a question touches the graph: the entities that it names, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import norm_name, stem

#: What a hit by words in any order is worth beside one by the whole phrase, and how many hits a question gets.
LOOSE, LIMIT = 0.7, 5


def name_words(name: Column) -> Column:
    return F.filter(F.split(name, "-"), lambda w: w != "")


def stems(name: Column) -> Column:
    return F.array_distinct(F.transform(name_words(name), stem))


def by_phrase(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, id): names that stand in a question word for word.

    questions: question_id, asked (normal form); names: id, name_norm. Runs of words of the
    lengths that names have are looked up, so no question is compared with every name.
    """
    lengths = names.select(F.size(name_words(F.col("name_norm"))).alias("n")).distinct()
    longest = lengths.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    words = questions.select("question_id", name_words(F.col("asked")).alias("w")).where("size(w) > 0")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), "-"))))
    return words.select("question_id", F.explode(F.array_distinct(runs)).alias("name_norm")).join(names.select("id", "name_norm"), "name_norm").select("question_id", "id")


def by_words(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, id): names of two words or more, one of four letters at least, all of whose words a question has by their stems, in any order.

    Each name is looked up by the rarest of its words only, then compared in full.
    """
    known = names.select("id", stems(F.col("name_norm")).alias("words"), F.size(name_words(F.col("name_norm"))).alias("n")).where("n >= 2").where(F.exists("words", lambda w: F.length(w) >= 4)).drop("n")
    each = known.select("id", F.explode("words").alias("word"))
    frequency = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = each.join(frequency, "word").groupBy("id").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    texts = questions.select("question_id", stems(F.col("asked")).alias("have"))
    hit = texts.select("question_id", F.explode("have").alias("word")).join(rarest, "word").select("question_id", "id")
    return hit.join(known, "id").join(texts, "question_id").where(F.size(F.array_except("words", "have")) == 0).select("question_id", "id")


def anchors(questions: DataFrame, entities: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(question_id, id, score, rank): the entities that each question names, the longest names first.

    questions: question_id, text; entities: id, canonical_id, env, display_name. A hit word for
    word outranks one by words in any order; an entity in production counts a little more.
    Ties go to the smaller id; null and empty questions have none.
    """
    names = entities.where("canonical_id = id").select("id", "env", norm_name(F.col("display_name")).alias("name_norm")).where("name_norm <> ''")
    asked = questions.select("question_id", norm_name(F.col("text")).alias("asked")).where("asked <> ''")
    hits = by_phrase(asked, names).withColumn("worth", F.lit(1.0)).union(by_words(asked, names).withColumn("worth", F.lit(LOOSE)))
    best = hits.groupBy("question_id", "id").agg(F.max("worth").alias("worth")).join(names, "id")
    scored = best.withColumn("score", F.round((F.length("name_norm") + F.when(F.col("env") == "prod", 1).otherwise(0)) * F.col("worth"), 3))
    place = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= limit).select("question_id", "id", "score", "rank")
