import random

import pytest

from attesta.llm.duplicates import Trie, count_copies, duplicate_records, radix_buckets

EVIDENCE, ENTITY = "evidence_id long, span_text string, first string, canon string", "id string, kind string, env string, display_name string"


def test_trie_counts_through_bursts():
    rnd = random.Random(2)
    words = [bytes(rnd.choices(b"ab", k=rnd.randrange(14))) for _ in range(4000)]
    trie, want = Trie(), {}
    for i, w in enumerate(words):
        trie.add(w, 1, f"{i:05}")
        n, first = want.get(w, (0, f"{i:05}"))
        want[w] = n + 1, min(first, f"{i:05}")
    assert {k: (n, f) for k, n, f in trie.items()} == want and trie.size == len(want)


@pytest.mark.parametrize("capacity", [3, 50, 100_000])
def test_counts_with_recursive_buckets(spark, capacity):
    rnd = random.Random(4)
    texts = ["same" * 50] * 300 + ["same" * 50 + rnd.choice("xyz") for _ in range(100)] + ["".join(rnd.choices("ab", k=rnd.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t.encode(), f"{i:04}") for i, t in enumerate(texts)], "canon binary, first string").repartition(6)
    got = {bytes(r.canon).decode(): (r.n, r.first) for r in count_copies(df, 1, capacity).collect()}
    want = {t: (texts.count(t), f"{texts.index(t):04}") for t in set(texts)}
    assert got == want


def test_what_is_the_same(spark):
    spans = [
        (5, "Foo(bar);\n"), (3, "foo bar"), (9, "FOO​ BAR"), (4, "foo baz"),
        (10, "A=1\nB=2\nC=x"), (11, "{'c': 'x', \"b\": 2, a: 1}"), (12, "a: 1; c: x; b: 3"), (13, "A=1\nB=2"), (14, "b=2\na=1"),
        (20, "x = f(1)\ny = 2\nz = 3"), (21, "y = 2\nx = f(1)\nz = 3"),
        (30, None), (31, ""), (32, "--"), (33, "..."), (40, "ß é"), (41, "É"), (42, "é"), (50, "q" * 100_000), (51, "Q " * 100_000),
    ]
    entities = [("b", "team", "prod", "Pay-Team"), ("a", "team", "prod", "pay team"), ("c", "team", None, "payteam"), ("d", "team", None, "PAYTEAM"), ("e", "person", "prod", "pay team"), ("f", None, None, None), ("g", "x", "y", "!?")]
    evidence = spark.createDataFrame([(i, t, "clash", "clash") for i, t in spans], EVIDENCE)
    got = {(r.src, r.rec_id): (r.first_id, r.copies) for r in duplicate_records(evidence, spark.createDataFrame(entities, ENTITY)).collect()}
    want = {("evidence", str(i)): (str(f), n) for f, n, group in ((3, 3, (3, 5, 9)), (10, 2, (10, 11)), (41, 2, (41, 42)), (50, 2, (50, 51))) for i in group}
    want |= {("entity", i): (f, 2) for f, group in (("a", "ab"), ("c", "cd")) for i in group}
    assert got == want


def test_empty_tables(spark):
    assert duplicate_records(spark.createDataFrame([], EVIDENCE), spark.createDataFrame([], ENTITY)).count() == 0


def test_first_id_is_the_smallest_number(spark):
    evidence = spark.createDataFrame([(100, "a b", "", ""), (20, "ab", "", ""), (-3, "AB", "", "")], EVIDENCE)
    got = duplicate_records(evidence, spark.createDataFrame([], ENTITY)).select("first_id").distinct().collect()
    assert [r[0] for r in got] == ["-3"]
    

def test_no_bucket_of_different_texts_is_over_the_capacity(spark):
    rnd = random.Random(6)
    texts = {"kservicename" + "".join(rnd.choices("abc", k=rnd.randint(0, 40))) for _ in range(600)}
    partials = spark.createDataFrame([(t.encode(), 1, "") for t in sorted(texts)], "canon binary, n long, first string")
    sizes = [r["count"] for r in radix_buckets(partials, 20).groupBy("bucket").count().collect()]
    assert sum(sizes) == len(texts) and max(sizes) <= 20
