"""Filling fixed-capacity containers with texts while keeping a mixture of sources.

Deficit round-robin serves one queue a source: in each window a queue may pass its share of
the window's tokens, and what it passed too much or too little is carried on. A queue's
carried deficit is its running total less its share of the windows so far, so a text's window
follows from the running total before it: divided by the queue's weight it is the round in
which the text's turn comes, and what all queues have passed by that round is known from
their totals (one that ran dry has passed all, the others share what it leaves). Local sums
in each partition plus the sums of the partitions before carry the deficits across windows
and partitions, with no pass through one task. The texts of a window, never more than its
tokens, are then packed best fit, longest first.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.credentials import encoding
from attesta.session import settle

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Containers of a window are numbered from window << LOCAL_BITS.
LOCAL_BITS = 24


def _counted(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(vocabulary, pattern)
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens); null and empty texts have none, a null source is a queue of its own."""
    import public_tokenizers as public

    path, pattern = vocabulary or public.path(VOCABULARY), public.PATTERN
    rows = documents.where("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    return rows.mapInArrow(_counted(path, pattern), "doc_id long, source string, tokens long")


def parts(counts: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, source, part, tokens, cost): a row for each container that a text fills, and its rest.

    A part costs one token at least, so a window never holds more parts than tokens.
    """
    full = F.floor(F.col("tokens") / capacity)
    rest = F.col("tokens") - full * capacity
    number = F.when((rest > 0) | (full == 0), full).otherwise(full - 1)
    split = counts.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), number)).alias("part")).withColumn("part", F.col("part").cast("int"))
    size = F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part") * capacity)
    return split.select("doc_id", "source", "part", size.alias("tokens")).withColumn("cost", F.greatest("tokens", F.lit(1)))


def running(sized: DataFrame, chunk: int) -> DataFrame:
    """``sized`` with ``before``, what its source's queue holds before it, in order of a hash of the id.

    Sums run inside chunks of about ``chunk`` cost, over the chunks of a block, and over blocks.
    """
    total = sized.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    chunks = max(1, total // chunk)
    wide = max(1, int(chunks**0.5))
    placed = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))).withColumn("block", F.floor(F.col("chunk") / wide))

    def ahead(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
        queue = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum("size").over(queue), F.lit(0))).drop("size")

    each = placed.groupBy("source", "block", "chunk").agg(F.sum("cost").alias("size"))
    blocks = ahead(each.groupBy("source", "block").agg(F.sum("size").alias("size")), ["source"], "block", "of_blocks")
    bases = ahead(each, ["source", "block"], "chunk", "of_chunks").join(blocks, ["source", "block"]).select("source", "chunk", (F.col("of_blocks") + F.col("of_chunks")).alias("base"))
    inside = W.partitionBy("source", "chunk").orderBy("doc_id", "part").rowsBetween(W.unboundedPreceding, -1)
    return placed.join(bases, ["source", "chunk"]).withColumn("before", F.col("base") + F.coalesce(F.sum("cost").over(inside), F.lit(0))).drop("chunk", "block", "base")


def windows(sized: DataFrame, window_tokens: int, capacity: int, targets: dict[str, float] | None = None, chunk: int = 1 << 20) -> DataFrame:
    """``sized`` with the window that serves each part and the ``target`` share of its source there.

    ``targets`` gives proportions of some sources. If they add up to less than 1, the others
    get what is left, each by its tokens; else they follow once the named ones are dry. By
    default each source gets its share of all tokens. A queue that runs dry leaves its share
    to the others. ``window_tokens`` must leave room for one part of each served source, as
    no window holds more than its tokens.
    """
    held = sized.groupBy("source").agg(F.sum("cost").alias("held"))
    named = {k: v for k, v in (targets or {}).items() if v > 0}
    scale = max(1.0, sum(named.values()))
    weight = {k: v / scale for k, v in named.items()}
    left = max(0.0, 1.0 - sum(weight.values()))
    if left < 1e-9:
        left = 0.0
    # The driver gets the number of sources and the totals of the named ones; the others count as one.
    group = F.when(F.col("source").isin(*weight), F.col("source")) if weight else F.lit(None).cast("string")
    rows = held.groupBy(group.alias("g")).agg(F.sum("held").alias("held"), F.count(F.lit(1)).alias("n")).collect()
    sources, totals = sum(r["n"] for r in rows), {r["g"]: r["held"] for r in rows}
    room = window_tokens - sources * capacity
    if rows and room < window_tokens // 2:
        raise ValueError(f"a window of {window_tokens} tokens is too small for {sources} sources; it needs {2 * sources * capacity}")
    queues = [(totals[k], weight.get(k, left)) for k in totals if weight.get(k, left) > 0]
    served = sum(t for t, _ in queues)
    others = float(totals.get(None, 0)) or 1.0

    own = F.lit(1.0)  # a source's part of its group
    if None in totals:
        own = F.when(group.isNull(), F.col("held") / others).otherwise(1.0)
    rate = F.lit(left)
    for k, v in weight.items():
        rate = F.when(F.col("source") == k, v).otherwise(rate)
    turn = F.col("before") / F.when(F.col("rate") > 0, F.col("rate") * F.col("own")).otherwise(F.col("own"))

    dry = sorted((t / w, t, w) for t, w in queues)
    passed, share = F.lit(0.0), F.lit(0.0)
    for k in range(len(dry) - 1, -1, -1):  # between two turns at which queues run dry all others go on
        done, active = sum(t for _, t, _ in dry[:k]), sum(w for *_, w in dry[k:])
        here = F.col("turn") <= dry[k][0]
        passed = F.when(here, done + F.col("turn") * active).otherwise(passed)
        share = F.when(here, F.col("rate") * F.col("own") / active).otherwise(share)
    if not left:  # those without a weight come after all others
        passed = F.when(F.col("rate") > 0, passed).otherwise(served + F.col("turn"))
        share = F.when(F.col("rate") > 0, share).otherwise(F.col("own"))
    queued = running(sized, chunk).join(held, "source").withColumn("rate", rate).withColumn("own", own).withColumn("turn", turn)
    return queued.withColumn("window", F.floor(passed / max(1, room)).cast("long")).withColumn("target", share).select("doc_id", "source", "part", "tokens", "window", "target")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """A container number for each size, longest first into the fullest container that takes it."""
    spaces: list[tuple[int, int]] = []
    place = [0] * len(sizes)
    made = 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(spaces, (sizes[i], -1))
        if at < len(spaces):
            space, number = spaces.pop(at)
        else:
            space, number, made = capacity, made, made + 1
        place[i] = number
        insort(spaces, (space - sizes[i], number))
    return place


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        window = table.column("window")[0].as_py()
        rows = sorted(zip(*(table.column(n).to_pylist() for n in ("doc_id", "part", "tokens"))))
        number = [(window << LOCAL_BITS) + p for p in best_fit([r[2] for r in rows], capacity)]
        return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([r[1] for r in rows], pa.int32()), "tokens": pa.array([r[2] for r in rows], pa.int64()), "container": pa.array(number, pa.int64())})

    return run


def _served(documents: DataFrame, capacity: int, window_containers: int, targets: dict[str, float] | None, vocabulary: str | None) -> DataFrame:
    sized = parts(settle(token_counts(documents, vocabulary)), capacity)
    return windows(sized, capacity * window_containers, capacity, targets)


def pack(documents: DataFrame, capacity: int = 2048, window_containers: int = 256, targets: dict[str, float] | None = None, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, part, tokens, container): every text's container, one row a part.

    documents: doc_id, source, text, one row per id. A text longer than ``capacity`` fills
    containers of its own and only its rest is packed with others; no other text is split.
    Null and empty texts get a container like any other. No rows give no rows.
    """
    served = _served(documents, capacity, window_containers, targets, vocabulary)
    return served.select("doc_id", "part", "tokens", "window").groupBy("window").applyInArrow(_packed(capacity), "doc_id long, part int, tokens long, container long")


def mixture(documents: DataFrame, capacity: int = 2048, window_containers: int = 256, targets: dict[str, float] | None = None, vocabulary: str | None = None) -> DataFrame:
    """(window, source, tokens, share, target, deviation): what each source contributes to each
    window, beside the share that its queue was to get."""
    served = _served(documents, capacity, window_containers, targets, vocabulary)
    each = served.groupBy("window", "source").agg(F.sum("tokens").alias("tokens"), F.round(F.avg("target"), 6).alias("target"))
    share = F.round(F.col("tokens") / F.sum("tokens").over(W.partitionBy("window")), 6)
    return each.withColumn("share", share).withColumn("deviation", F.round(F.col("share") - F.col("target"), 6)).select("window", "source", "tokens", "share", "target", "deviation")


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(window, parts, containers, tokens, fill) of ``pack``'s rows: how much of the containers' space is used."""
    each = packed.withColumn("window", F.shiftright("container", LOCAL_BITS)).groupBy("window", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"))
    whole = each.groupBy("window").agg(F.sum("parts").alias("parts"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return whole.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
