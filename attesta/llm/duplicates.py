"""Duplicates hidden by formatting: recursive radix partitioning and per-bucket tries.

Each text becomes canonical bytes: its letters and digits in lower case, for texts made of
key-value fields the sorted fields. Every input task first counts its own texts in a trie,
so a text that holds a third of all rows leaves each task as one row. The partial counts
are split by their first bytes; buckets over the capacity are split by further bytes until
each fits; a trie per bucket then adds the terminal counters up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import forget, settle, shuffle_partitions

NOT_WORD = r"[^\p{L}\p{Nd}]+"
#: One key-value field: a bare or quoted key, a separator, a quoted value or one without calls and brackets.
FIELD = r"""^\s*["']?[\p{L}_][\p{L}\p{Nd}_.\- /]*["']?\s*[:=]\s*("[^"]*"|'[^']*'|[^"'(){}\[\]<>=]*)\s*$"""
BURST, CHUNK = 256, 4


class Trie:
    """Burst trie: containers of suffixes with terminal counters [n, first]; a full container
    bursts into one child for each next chunk of bytes, so common prefixes are stored once."""

    def __init__(self) -> None:
        self.root: list = [None, {}]  # children by chunk, or None in a container; suffixes
        self.size = 0

    def add(self, key: bytes, n: int, first: str) -> None:
        node, at = self.root, 0
        while node[0] is not None and len(key) - at >= CHUNK:
            piece = key[at : at + CHUNK]
            child = node[0].get(piece)
            if child is None:
                child = node[0][piece] = [None, {}]
            node, at = child, at + CHUNK
        rest = key[at:]
        slot = node[1].get(rest)
        if slot is None:
            node[1][rest] = [n, first]
            self.size += 1
            if node[0] is None and len(node[1]) > BURST:
                self._burst(node)
        else:
            slot[0] += n
            if first < slot[1]:
                slot[1] = first

    @staticmethod
    def _burst(node: list) -> None:
        children: dict = {}
        short = {}
        for rest, slot in node[1].items():
            if len(rest) < CHUNK:
                short[rest] = slot
            else:
                children.setdefault(rest[:CHUNK], [None, {}])[1][rest[CHUNK:]] = slot
        node[0], node[1] = children, short

    def items(self) -> Iterator[tuple[bytes, int, str]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, (children, suffixes) = stack.pop()
            for rest, (n, first) in suffixes.items():
                yield prefix + rest, n, first
            for piece, child in (children or {}).items():
                stack.append((prefix + piece, child))


def _rows(trie: Trie, least: int) -> Iterator[pa.RecordBatch]:
    keys, counts, firsts = [], [], []
    for key, n, first in trie.items():
        if n >= least:
            keys.append(key)
            counts.append(n)
            firsts.append(first)
    for i in range(0, len(keys), 20_000):
        part = slice(i, i + 20_000)
        yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.binary()), pa.array(counts[part], pa.int64()), pa.array(firsts[part], pa.string())], ["canon", "n", "first"])


def count_locally(entries: int = 100_000):
    """Counts of one task's rows; the trie is emptied whenever it holds ``entries`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            for key, n, first in zip(*(batch.column(k).to_pylist() for k in range(3))):
                trie.add(key, n, first)
            if trie.size > entries:
                yield from _rows(trie, 1)
                trie = Trie()
        yield from _rows(trie, 1)

    return run


def count_buckets(least: int):
    """Totals of each bucket; rows come sorted by bucket, so one trie is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current = Trie(), None
        for batch in batches:
            for bucket, key, n, first in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if bucket != current:
                    yield from _rows(trie, least)
                    trie, current = Trie(), bucket
                trie.add(key, n, first)
        yield from _rows(trie, least)

    return run


def radix_buckets(partials: DataFrame, capacity: int, first: int = 8) -> DataFrame:
    """``partials`` with a column ``bucket``: the shortest tried prefix of at most ``capacity`` rows.

    The first split is by ``first`` bytes at once; prefixes over the capacity are split by
    twice as many bytes, until each fits or is a whole text, which a trie holds as one entry.
    The oversized prefixes of a depth are a table of at most rows / capacity rows; whether
    it is small enough to be sent to all tasks or is joined by a shuffle is Spark's choice
    by its size.
    """
    depth = first
    bucketed, live = partials.withColumn("bucket", F.substring("canon", 1, depth)), partials
    while True:
        cut = F.substring("canon", 1, depth)
        opened = settle(live.where(F.length("canon") > depth).groupBy(cut.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > capacity).select("prefix"))
        if opened.isEmpty():
            forget(opened)
            return bucketed
        live = live.join(opened, cut == F.col("prefix"), "left_semi")
        depth *= 2
        bucketed = (
            bucketed.join(opened, F.col("bucket") == F.col("prefix"), "left")
            .withColumn("bucket", F.when(F.col("prefix").isNotNull(), F.substring("canon", 1, depth)).otherwise(F.col("bucket"))).drop("prefix")
        )


def count_copies(keys: DataFrame, least: int = 1, capacity: int = 100_000) -> DataFrame:
    """(canon, n, first) of every canonical text that occurs ``least`` times or more.

    ``keys`` has canon (binary) and first (string, compared as such); null texts are left out.
    """
    partials = (
        keys.where("canon is not null").select("canon", F.lit(1).cast("long").alias("n"), "first")
        .mapInArrow(count_locally(), "canon binary, n long, first string")
        .transform(settle)
    )
    bucketed = radix_buckets(partials, capacity).select("bucket", "canon", "n", "first")
    return (
        bucketed.repartition(shuffle_partitions(keys.sparkSession), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(count_buckets(least), "canon binary, n long, first string")
    )


def plain_canon(text: Column) -> Column:
    """Letters and digits in lower case; null where there are none."""
    return F.nullif(F.lower(F.regexp_replace(text, NOT_WORD, "")), F.lit(""))


def field_canon(text: Column) -> Column:
    """Sorted fields of a text that consists only of key-value fields; null for others."""
    inner = F.regexp_replace(F.regexp_replace(text, r"(?U)^[\s`]*[\[({]?|[\])}]?[\s`;,]*$", ""), "​", "")
    fields = F.filter(F.split(inner, r"[\n\r,;]+"), lambda f: F.length(F.regexp_replace(f, NOT_WORD, "")) > 0)
    whole = (F.size(fields) >= 3) & F.forall(fields, lambda f: f.rlike("(?U)" + FIELD))
    return F.when(whole, F.array_join(F.array_sort(F.transform(fields, lambda f: F.lower(F.regexp_replace(f, NOT_WORD, "")))), "\n"))


def evidence_keys(evidence: DataFrame) -> DataFrame:
    """src, rec_id, first (sortable id) and canon of each citation with letters or digits.

    A field text's canonical form is its sorted fields, any other's its letters and digits.
    """
    plain, fields = plain_canon(F.col("span_text")), field_canon(F.col("span_text"))
    rank = F.lpad((F.col("evidence_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return (
        evidence.where("span_text is not null and evidence_id is not null").select(
            F.lit("evidence").alias("src"), F.col("evidence_id").cast("string").alias("rec_id"), rank.alias("first"),
            F.coalesce(F.concat(F.lit("k"), fields), F.concat(F.lit("v"), plain)).cast("binary").alias("canon"))
        .where("canon is not null")
    )


def entity_keys(entity: DataFrame) -> DataFrame:
    """The same for entities; kind and env are part of the key, a null equals a null."""
    scope = F.concat_ws("\n", F.lit("t"), F.coalesce(F.concat(F.lit("="), "kind"), F.lit("")), F.coalesce(F.concat(F.lit("="), "env"), F.lit("")))
    return (
        entity.where("id is not null").select(
            F.lit("entity").alias("src"), F.col("id").alias("rec_id"), F.col("id").alias("first"),
            F.concat(scope, F.lit("\n"), plain_canon(F.col("display_name"))).cast("binary").alias("canon"))
        .where("canon is not null")
    )


def duplicate_records(evidence: DataFrame, entity: DataFrame, capacity: int = 100_000) -> DataFrame:
    """(src, rec_id, first_id, copies) of each record in a group of two or more.

    Both inputs hold one row per id. Null texts and texts without letters and digits are in
    no group; empty tables give no rows. The last join has one row per group on its right
    side; a group with a third of all records is split there by adaptive execution.
    """
    keys = evidence_keys(evidence).unionByName(entity_keys(entity)).persist(StorageLevel.MEMORY_AND_DISK)
    groups = count_copies(keys.select("canon", "first"), 2, capacity)
    digest = F.md5("canon")
    joined = keys.select("src", "rec_id", digest.alias("k")).join(groups.select(digest.alias("k"), "n", F.col("first")), "k")
    number = (F.col("first").cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string")
    return joined.select("src", "rec_id", F.when(F.col("src") == "evidence", number).otherwise(F.col("first")).alias("first_id"), F.col("n").alias("copies"))
