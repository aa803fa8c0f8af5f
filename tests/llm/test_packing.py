import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from attesta.llm import packing as P
from attesta.llm.credentials import encoding

SCHEMA = "doc_id long, source string, text string, tokens string, window string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    words = ["alpha", "beta", "queue", "naïve", "размер", "x1", "\n"]
    docs = [(i, rnd.choice(["hot", "hot", "git", None]), " ".join(rnd.choices(words, k=rnd.choice([1, 5, 40, 90]))), "c", "c") for i in range(400)]
    return docs + [(1000, "git", None, "", ""), (1001, "git", "", "", ""), (1002, "rare", "word " * 3000, "", "")]


def test_every_token_is_packed_once_and_nothing_overflows(spark, rows):
    capacity = 128
    packed = P.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity, 32).collect()
    tokenizer = encoding(public_tokenizers.path(P.VOCABULARY), public_tokenizers.PATTERN)
    sizes = {d: len(tokenizer.encode_ordinary(t or "")) for d, _, t, *_ in rows}
    total, fill = {}, {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert total == sizes and max(fill.values()) <= capacity
    windows = {}
    for r in packed:
        windows[r.container >> P.LOCAL_BITS] = windows.get(r.container >> P.LOCAL_BITS, 0) + max(1, r.tokens)
    assert max(windows.values()) <= 32 * capacity
    assert len({(r.doc_id, r.part) for r in packed}) == len(packed)
    assert all(sum(1 for r in packed if r.doc_id == d) == max(1, -(-n // capacity)) for d, n in sizes.items())
    assert sum(sizes.values()) / (len(fill) * capacity) > 0.95


def sized(spark, queues):
    """Parts of given sources and costs."""
    out = [(1000 * k + i, source, 0, c, c) for k, (source, costs) in enumerate(queues.items()) for i, c in enumerate(costs)]
    return spark.createDataFrame(out, "doc_id long, source string, part int, tokens long, cost long")


def served(df, window, capacity, targets):
    out = {}
    for r in P.windows(df, window, capacity, targets, chunk=500).collect():
        slot = out.setdefault(r.window, {})
        slot[r.source] = slot.get(r.source, 0) + r.tokens
    return out


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.5, "b": 0.25}, {"c": 3.0, "d": 1.0}, {"a": 0.6, "nobody": 0.4}])
def test_windows_hold_the_targets_and_never_more_than_their_tokens(spark, targets):
    rnd = random.Random(5)
    queues = {s: [rnd.randint(1, 20) for _ in range(n)] for s, n in (("a", 900), ("b", 300), ("c", 500), ("d", 100))}
    df, totals = sized(spark, queues), {s: sum(c) for s, c in queues.items()}
    window, capacity = 1000, 20
    got = served(df, window, capacity, targets)
    assert {s: sum(w.get(s, 0) for w in got.values()) for s in totals} == totals
    assert sorted(got) == list(range(len(got))) and max(sum(w.values()) for w in got.values()) <= window
    # The same by a simulation of the rounds, queue by queue.
    whole = sum(totals.values())
    weight = {s: totals[s] / whole for s in totals} if targets is None else {s: targets.get(s, 0) / max(1, sum(targets.values())) for s in totals}
    rest = 1 - sum(weight.values()) - (0 if targets is None else sum(v for s, v in targets.items() if s not in totals) / max(1, sum(targets.values())))
    unnamed = [s for s in totals if not weight[s]]
    for s in unnamed:
        weight[s] = max(0.0, rest) * totals[s] / sum(totals[u] for u in unnamed) if rest > 1e-9 else 0.0
    room, done = window - 4 * capacity, dict.fromkeys(totals, 0.0)
    for w in range(len(got)):
        quantum = room
        while quantum > 1e-6:
            live = {s: weight[s] for s in totals if done[s] < totals[s] - 1e-6 and weight[s]} or {s: totals[s] for s in totals if done[s] < totals[s] - 1e-6}
            if not live:
                break
            step = min([quantum / sum(live.values()), *((totals[s] - done[s]) / live[s] for s in live)])
            for s in live:
                done[s] += step * live[s]
            quantum -= step * sum(live.values())
        for s in totals:
            assert abs(sum(got[v].get(s, 0) for v in range(w + 1)) - done[s]) <= capacity, (w, s)


def test_too_small_a_window_is_refused(spark):
    with pytest.raises(ValueError):
        P.windows(sized(spark, {"a": [1], "b": [2]}), 50, 20)


def test_mixture_and_fill(spark, rows):
    df = spark.createDataFrame(rows[:400], SCHEMA)
    found = P.mixture(df, 128, 32, {"hot": 0.5, "git": 0.3}).collect()
    assert all(abs(r.deviation) < 0.1 for r in found if r.window == 0) and {r.source for r in found if r.window == 0} == {"hot", "git", ""}
    packed = P.pack(df, 128, 32)
    assert P.fill(packed, 128).agg(F.sum("tokens"), F.sum("parts")).first() == packed.agg(F.sum("tokens"), F.count("*")).first()


def test_best_fit():
    assert P.best_fit([], 10) == [] and P.best_fit([0], 10) == [0]
    assert len(set(P.best_fit([6, 4, 7, 3, 5, 5], 10))) == 3


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA)).count() == 0 and P.mixture(spark.createDataFrame([], SCHEMA)).count() == 0
