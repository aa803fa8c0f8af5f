import random
import uuid

from attesta.llm.groups import entity_groups, hash_to_min


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_hash_to_min_on_random_graphs_chains_and_stars(spark):
    rnd = random.Random(1)
    edges = [(f"n{rnd.randrange(150):03}", f"n{rnd.randrange(150):03}") for _ in range(120)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("s000", f"s{i:03}") for i in range(1, 200)] + [("loop", "loop")] + [(b, a) for a, b in edges[:20]]
    df = spark.createDataFrame([*edges, (None, "x"), ("y", None)], "a string, b string")
    assert dict(hash_to_min(df).collect()) == components(edges)


def test_no_edges(spark):
    assert hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_ids_in_any_writing_and_only_confirmed_rows(spark):
    ids = sorted(str(uuid.UUID(int=i)) for i in range(1, 8))
    a, b, c, d, e, f, g = ids
    entity = spark.createDataFrame([(i, {e: "{" + f.upper() + "}"}.get(i, i), "x") for i in ids], "id string, canonical_id string, method string")
    rows = [(a.upper(), b.replace("-", ""), " Merged\n"), (c, b, "merged"), (d, a, "distinct"), (d, a, None), (None, d, "merged"), (g, str(uuid.UUID(int=99)), "merged"), (str(uuid.UUID(int=99)), d, "merged")]
    candidates = spark.createDataFrame(rows, "from_id string, into_id string, resolution string")
    got = sorted(tuple(r) for r in entity_groups(candidates, entity).collect())
    assert got == sorted([(a, a), (b, a), (c, a), (e, e), (f, e)])


def test_rounds_leave_one_table_behind(spark):
    from attesta import session

    before = len(session._written)
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)], "a string, b string")
    assert hash_to_min(edges).count() == 61 and len(session._written) == before + 1
