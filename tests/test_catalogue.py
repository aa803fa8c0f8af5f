import itertools
import random

from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import anchors, gaps, resolve

ENTITY = "id string, canonical_id string, kind string, env string, display_name string, provisional boolean"


def entity(i, kind, name, env="unknown", provisional=False, canonical=None):
    return (i, canonical or i, kind, env, name, provisional)


def dice(a, b):
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def test_near_names_equal_brute_force(spark):
    rnd = random.Random(5)
    parts = ["pay", "ment", "ser", "vice", "cache", "a", "b", "xy", "ledger", "-", "1"]
    names = sorted({"".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(250)} | {"ab", "abc", "abd", "service-b", "service-c", "a"})
    df = spark.createDataFrame([entity(f"e{i:03}", "service", n) for i, n in enumerate(names)] + [entity("z", "cache", "service-b")], ENTITY)
    got = {(r.name_a, r.name_b): r.score for r in resolve.near_names(df).collect()}
    norm = sorted({r[0] for r in df.where("kind = 'service'").select(text.norm_name(F.col("display_name"))).collect() if r[0]})
    want = {(a, b): round(dice(a, b), 6) for a, b in itertools.combinations(norm, 2) if round(dice(a, b), 6) >= 0.7}
    assert got == want and got[("service-b", "service-c")] == 0.875


def test_near_pairs_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 30)
    rnd = random.Random(9)
    parts = ["pay", "ment", "ser", "vice", "cache", "a", "b", "xy", "ledger", "-", "1", "a-rather-long-common-part-of-names"]
    names = sorted({"".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(200)} | {"ab", "abc", "a", "aaaa"})
    rows = [("one", n, None) for n in names] + [("two", n, 0) for n in names[::2]] + [("two", n, 1) for n in names[::3]] + [("left", n, 0) for n in names[:5]]
    got = {(r.grp, r.name_a, r.name_b): r.score for r in resolve.near_pairs(spark.createDataFrame(rows, "grp string, name_norm string, side int")).collect()}
    within = {("one", a, b): dice(a, b) for a, b in itertools.combinations(names, 2)}
    across = {("two", a, b): dice(a, b) for a in names[::2] for b in names[::3] if a != b}
    assert got == {k: round(v, 6) for k, v in (within | across).items() if round(v, 6) >= 0.7}


def test_near_pairs_make_rows_by_blocks_not_by_bigrams(spark):
    name = "a-name-with-so-many-different-bigrams-that-triples-of-them-would-be-a-million-rows-0123456789/qxz"
    pairs = resolve.near_pairs(spark.createDataFrame([("g", f"{name}{i}", None) for i in range(20)], "grp string, name_norm string, side int"))
    assert pairs.count() == 190 and "FlatMapGroupsInArrow" in pairs._jdf.queryExecution().toString()


def test_proposals_from_blocks_are_the_best_of_all(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 20)
    rnd = random.Random(3)
    names = sorted({"".join(rnd.choices(["pay", "ment", "vice", "cache", "b", "-x", "ledger"], k=rnd.randint(2, 4))) for _ in range(120)})
    known, asked = names[::2], names[::3]
    entities = spark.createDataFrame([entity(f"e{i:03}", "service" if i % 2 else "client", n) for i, n in enumerate(known)], ENTITY)
    minted = spark.createDataFrame([(f"m{i:03}", "service" if i % 3 else None, "unknown", n) for i, n in enumerate(asked)], "entity_id string, kind string, env string, name_norm string")
    norm = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(known)], "i int, n string").orderBy("i").select(text.norm_name(F.col("n"))).collect()]
    want = {}
    for i, n in enumerate(asked):
        scored = [(-(1.0 if n == m else round(dice(n, m), 6)), f"e{k:03}") for k, m in enumerate(norm) if i % 3 == 0 or k % 2]
        if scored and -min(scored)[0] >= 0.7:
            want[f"m{i:03}"] = (min(scored)[1], -min(scored)[0])
    assert {r.entity_id: (r.id, r.score) for r in resolve.proposals(minted, entities).collect()} == want


def test_aliases_respect_environment_and_family(spark):
    entities = spark.createDataFrame([entity("p", "datastore", "Orders DB", "prod"), entity("s", "datastore", "orders_db", "staging"), entity("q", "queue", "Jobs", "prod"), entity("r", "repo", "App"), entity("k", "package", "tool")], ENTITY)
    asked = [(1, "orders-db", "datastore", "prod"), (2, "ORDERS DB", "datastore", None), (3, "jobs", None, None), (4, "app", "component", None), (5, "Tool", "repo", None), (6, None, None, None), (7, "!!", None, None)]
    got = {r.mention_id: r.id for r in resolve.alias_matches(spark.createDataFrame(asked, "mention_id long, raw string, kind string, env string"), entities).collect()}
    assert got == {1: "p", 3: "q", 5: "k"}  # 2 could be either environment, 4 is of another family


def test_minting_does_not_depend_on_order(spark):
    rows = [(1, "New Thing", "service", None), (2, "new_thing", "client", "unknown"), (3, "new-thing", "queue", "prod"), (4, "", None, None)]
    schema = "mention_id long, raw string, kind string, env string"
    none = spark.createDataFrame([], "mention_id long")
    one = resolve.mintable(spark.createDataFrame(rows, schema), none).collect()
    other = resolve.mintable(spark.createDataFrame(rows[::-1], schema), none).collect()
    assert sorted(one) == sorted(other) and sorted((r.kind, r.mentions) for r in one) == [("queue", 1), ("service", 2)]


def test_repairs_keep_the_best_and_never_bridge_environments(spark):
    entities = spark.createDataFrame([entity("a", "service", "Pay"), entity("b", "service", "pay", provisional=True), entity("c", "cache", "c1", "prod"), entity("d", "cache", "C1", "staging")], ENTITY)
    degrees = spark.createDataFrame([("b", 3)], "id string, degree long")
    assert [tuple(r) for r in resolve.repairs(entities, degrees).collect()] == [("a", "b")]


def test_barred_merges(spark):
    rows = [(1, "a", "b", None), (2, "b", "a", "distinct"), (3, "c", "d", None), (4, "a", "c", None)]
    entities = spark.createDataFrame([entity("a", "service", "a"), entity("b", "service", "b"), entity("c", "cache", "c", "prod"), entity("d", "cache", "d", "staging")], ENTITY)
    got = resolve.barred_merges(spark.createDataFrame(rows, "id long, subject string, object string, verdict string"), entities)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "distinct"), (3, "environments")]


def test_strong_identifiers_first_holder_keeps_them(spark):
    held = spark.createDataFrame([("e2", "arn", "x"), ("e1", "arn", "x"), ("e3", "url", "u")], "id string, authority string, value string")
    asked = spark.createDataFrame([(1, [("ARN", " x ")]), (2, [("url", "no")]), (3, None)], "mention_id long, identifiers array<struct<authority:string,value:string>>")
    assert [tuple(r) for r in resolve.strong_matches(asked, held).collect()] == [(1, "e1")]


def test_gaps_and_questions(spark):
    entities = spark.createDataFrame([entity("ep", "endpoint", "GET /n"), entity("web", "client", "web", provisional=True), entity("svc", "service", "svc"), entity("tech", "technology", "t"), entity("old", "service", "x", canonical="svc"),
                                      entity("con", "capability", "login")], ENTITY)
    edges = spark.createDataFrame([("1", "web", "calls", "ep"), ("2", "web", "lives_in_repo", "r"), ("3", "svc", "written_in", "tech")], "proposition_id string, subject string, predicate string, object string")
    proposals = spark.createDataFrame([("web", "svc", None), ("svc", "ep", None), ("ep", "svc", "distinct")], "subject string, object string, verdict string")
    found = gaps.scored(gaps.gaps(entities, edges, proposals, spark.createDataFrame([], "id string")))
    got = sorted((r.kind, r.id) for r in found.collect())
    assert got == sorted([("dangling_endpoint", "ep"), ("homeless_project", "svc"), ("unknown_technology", "web"), ("unidentified_entity", "web"), ("undescribed_concept", "con"), ("orphan_entity", "con"), ("name_collision", "web")])
    asked = gaps.askable(found, spark.createDataFrame([("svc",)], "id string")).collect()
    assert [(r.kind, r.id) for r in asked] == [("homeless_project", "svc"), ("name_collision", "web")]


def test_ranked_matches_prefer_kind_then_environment_then_scope(spark):
    entities = spark.createDataFrame(
        [("a", "a", "service", "prod", "Pay"), ("b", "b", "client", "prod", "Pay"), ("c", "c", "service", "staging", "Pay"), ("d", "d", "datastore", "prod", "Pay"), ("e", "e", "service", "unknown", "Log"), ("f", "f", "service", "unknown", "Log"), ("g", "a", "service", "prod", "Pay")],
        "id string, canonical_id string, kind string, env string, display_name string")
    aliases = spark.createDataFrame([(i, "pay", None) for i in "abcdg"] + [("e", "log", None), ("f", "log", None), ("f", "log", "repo:x")], "id string, name_norm string, scope string")
    asked = [(1, "Pay", "client", "prod", None), (2, "Pay", "service", "staging", None), (3, "pay", "service", None, None), (4, "LOG", None, None, "repo:x"), (5, "log", None, None, "repo:y"), (6, "pay", "cache", "prod", None), (7, None, None, None, None), (8, "", "service", None, None)]
    got = {r.mention_id: (r.id, r.rung) for r in resolve.ranked_matches(spark.createDataFrame(asked, "mention_id long, raw string, kind string, env string, scope string"), aliases, entities).collect()}
    assert got == {1: ("b", "alias_scoped"), 2: ("c", "alias_scoped"), 4: ("f", "alias_scoped"), 5: ("e", "alias_global"), 6: ("d", "alias_scoped")}


def test_proposals_take_the_most_alike_of_the_kind_and_environment(spark):
    entities = spark.createDataFrame([("a", "a", "service", "prod", "order-gateway"), ("b", "b", "service", "prod", "order-gatevay"), ("c", "c", "cache", "prod", "order-gateways"), ("d", "d", "service", "staging", "order-gateway")], "id string, canonical_id string, kind string, env string, display_name string")
    minted = spark.createDataFrame([("m", "service", "prod", "order-gatewa"), ("n", None, "prod", "order-gateways"), ("o", "service", "prod", "something-else"), ("p", "service", "staging", "order-gateway")], "entity_id string, kind string, env string, name_norm string")
    got = {r.entity_id: (r.id, round(r.score, 3)) for r in resolve.proposals(minted, entities).collect()}
    assert got == {"m": ("a", 0.957), "n": ("c", 1.0), "p": ("d", 1.0)}


def test_different_routes(spark):
    candidates = spark.createDataFrame([(1, "b", "a", None), (2, "a", "c", None), (3, "a", "b", "merged"), (4, "a", "x", None)], "id long, subject string, object string, verdict string")
    signatures = spark.createDataFrame([("a", "/x", "GET"), ("b", "/y", "GET"), ("c", "/x", "GET")], "id string, path string, method string")
    assert [tuple(r) for r in resolve.different_routes(candidates, signatures).collect()] == [(1, "a", "b")]


def test_anchors_rank_phrases_before_words(spark):
    entities = spark.createDataFrame(
        [("a", "a", "prod", "Notification List"), ("b", "b", None, "List"), ("c", "a", "prod", "list"), ("d", "d", "prod", "x y"), ("e", "e", "dev", "Notification List Service"), ("f", "f", None, None), ("g", "g", None, "?")], "id string, canonical_id string, env string, display_name string")
    asked = spark.createDataFrame([(1, "Where is the notification list?"), (2, "a list of notifications"), (3, "y x"), (4, None), (5, "")], "question_id long, text string")
    got = {}
    for r in anchors.anchors(asked, entities).orderBy("rank").collect():
        got.setdefault(r.question_id, []).append((r.id, round(r.score, 2)))
    assert got == {1: [("a", 18.0), ("b", 4.0)], 2: [("a", 12.6), ("b", 4.0)]}
    assert anchors.anchors(asked.where("false"), entities).count() == 0 and anchors.anchors(asked, entities.where("false")).count() == 0


def test_proposals_read_each_table_once_in_small_plans(spark, monkeypatch):
    from attesta.plans import catalogue

    plans, settle = [], resolve.settle

    def kept(d, *a, **k):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return settle(d, *a, **k)

    monkeypatch.setattr(resolve, "settle", kept)
    monkeypatch.setattr(catalogue, "settle", kept)
    found = catalogue.fuzzy_proposals(spark, "/root/testdata/sf0.001")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert [sum(p.count(f"/{t}.parquet") for p in plans) for t in ("mention", "entity")] == [1, 1]
    assert max(p.count("Exchange ") for p in plans) <= 8 and found.count() > 0
