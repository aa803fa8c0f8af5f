"""Similarity of vectors and of entities' profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES_PER_BLOCK = 2000


def _best(ids: np.ndarray, matrix: np.ndarray, k: int):
    """Each task's k best rows for every query of a block; rows of another length than the queries' are skipped."""
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and len(v) == unit.shape[1] and None not in v]
            if not rows:
                continue
            keys = np.array([i for i, _ in rows], np.int64)
            block = np.array([v for _, v in rows], np.float64)
            sizes = np.linalg.norm(block, axis=1, keepdims=True)
            scores = unit @ np.divide(block, sizes, out=np.zeros_like(block), where=sizes > 0).T
            scores[ids[:, None] == keys[None, :]] = -2.0
            keep = min(k + 8, len(keys))  # more than k, as equal scores are told apart by id afterwards
            top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            edge = np.take_along_axis(scores, top, 1).min(axis=1)
            q, r = np.nonzero(scores >= edge[:, None])
            real = scores[q, r] > -1.5
            q, r = q[real], r[real]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys[r]), pa.array(scores[q, r])], ["query_id", "id", "score"])

    return run


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank): the exact k nearest rows by cosine of each query.

    Both have id and embedding. Queries go out in blocks of QUERIES_PER_BLOCK, one scan of the
    vectors a block; each task keeps its best rows of each query (with all ties), so what is
    shuffled doesn't grow with the vectors a task holds. Vectors without length score 0; null
    vectors and those of another length are left out. Ties go to the smaller id.
    """
    asked = queries.where("id is not null and embedding is not null").select("id", "embedding")
    blocks = -(-asked.count() // QUERIES_PER_BLOCK)
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        if not part:
            continue
        ids, matrix = np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], np.float64)
        near = vectors.where("id is not null").select("id", "embedding").mapInArrow(_best(ids, matrix, k), "query_id long, id long, score double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bags(texts: DataFrame, dims: int = 256) -> DataFrame:
    """(id, embedding): how often words of each of ``dims`` digest classes occur; no model is needed.

    A text without words has no row. Counting by class comes before the gathering, so a text
    of any length gathers ``dims`` numbers at most.
    """
    words = texts.select("id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+")).alias("word")).where("word <> ''")
    dim = F.pmod(F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("int"), F.lit(dims))
    counted = words.groupBy("id", dim.alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    held = counted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "n"))).alias("m"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("float"))
    return held.select("id", slots.alias("embedding"))


def strength(score: F.Column) -> F.Column:
    return F.when(score >= 0.5, "strong").when(score >= 0.35, "moderate").otherwise("weak")


def profiles(entities: DataFrame, edges: DataFrame, relations: int = 12) -> DataFrame:
    """(id, profile, profile_hash): each entity's name, kind and first distinct relations in words.

    Relations are ranked before they are gathered, so a hub gathers no more than ``relations``.
    """
    names = entities.select("id", "display_name", "kind")
    other = names.select(F.col("id").alias("other"), F.col("display_name").alias("other_name"))
    out = edges.select(F.col("subject").alias("id"), F.col("object").alias("other"), F.concat(F.regexp_replace("predicate", "_", " "), F.lit(" ")).alias("words"))
    back = edges.select(F.col("object").alias("id"), F.col("subject").alias("other"), F.concat(F.lit("is what "), F.regexp_replace("predicate", "_", " "), F.lit(" for ")).alias("words"))
    said = out.union(back).join(other, "other").select("id", F.concat("words", "other_name").alias("phrase")).distinct()
    kept = said.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("phrase"))).where(F.col("nth") <= relations)
    text = kept.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("phrase")), ". ").alias("relations"))
    profile = F.concat_ws(". ", F.concat_ws(", ", "display_name", "kind"), "relations")
    return names.join(text, "id", "left").select("id", profile.alias("profile"), F.sha2(profile, 256).alias("profile_hash"))
