from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from attesta.functions.trust import freshness, trust_label
from attesta.operators import graph, temporal

CLAIM = "subject string, predicate string, object string, object_literal string, polarity boolean, method string, confidence double, created_at timestamp, scope_key string, proposition_id string"


def day(n, hour=0):
    return datetime(2024, 1, n, hour, tzinfo=timezone.utc)


def claim(s, p, o, at, method="human", polarity=True, confidence=None, scope=None, literal=False):
    return (s, p, None if literal else o, o if literal else None, polarity, method, confidence, at, scope, f"{s}|{p}|{o}")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CLAIM)


def edges(spark, rows, at="2024-01-01 00:00:00"):
    return {r.proposition_id: r for r in temporal.edges_at(frame(spark, *rows), at).collect()}


def test_same_claim_twice_is_one_edge_with_two_supports(spark):
    got = edges(spark, [claim("a", "reads_from", "x", day(1), "llm_inferred"), claim("a", "reads_from", "x", day(1), "code_derived")])
    assert len(got) == 1 and got["a|reads_from|x"].support_count == 2


def test_corroboration_by_another_method_raises_trust(spark):
    got = edges(spark, [claim("a", "p", "x", day(1), "code_derived"), claim("b", "p", "x", day(1), "code_derived"), claim("b", "p", "x", day(1), "telemetry")])
    assert got["b|p|x"].trust > got["a|p|x"].trust
    assert got["b|p|x"].trust == pytest.approx(0.9 * 1.1)


def test_refutation_lowers_trust_and_never_below_zero(spark):
    rows = [claim("a", "p", "x", day(1), "llm_inferred"), claim("a", "p", "x", day(1), "verifier", polarity=False), claim("b", "p", "x", day(1), "verifier", polarity=False)]
    got = edges(spark, rows)
    assert got["a|p|x"].trust == 0 and got["a|p|x"].refute_count == 1
    assert "b|p|x" not in got  # nothing but refutations


def test_nothing_is_seen_before_it_was_written(spark):
    rows = [claim("a", "p", "x", day(5))]
    assert not edges(spark, rows, "2024-01-04 23:59:59") and edges(spark, rows, "2024-01-05 00:00:00")


def test_freshness_halves_with_the_half_life(spark):
    df = spark.createDataFrame([("telemetry", day(1), day(15)), ("telemetry", day(15), day(1))], "m string, c timestamp, t timestamp")
    a, b = (r[0] for r in df.select(freshness(F.col("m"), F.col("c"), F.col("t"))).collect())
    assert a == pytest.approx(0.5) and b == 1


def test_bounds_are_half_open(spark):
    df = frame(spark, claim("a", "p", "x", day(1))).withColumn("valid_to", F.lit(day(3))).withColumn("valid_from", F.lit(day(2)))
    alive = [temporal.live(df, f"2024-01-0{d} 00:00:00").count() for d in (1, 2, 3)]
    assert alive == [0, 1, 0]


def test_a_functional_value_is_closed_by_the_next_different_one(spark):
    rows = [claim("s", "owned_by", v, day(d), literal=True) for v, d in (("red", 1), ("red", 2), ("blue", 3), ("red", 5))]
    closed = sorted((r.object_literal, r.created_at.day, r.valid_to and r.valid_to.day) for r in temporal.supersede(frame(spark, *rows)).collect())
    assert closed == [("blue", 3, 5), ("red", 1, 3), ("red", 2, 3), ("red", 5, None)]
    now = temporal.current_values(frame(spark, *rows), "2024-01-04 00:00:00").collect()
    assert [(r.value, r.claims) for r in now] == [("blue", 1)]


def test_refuting_a_value_closes_others_but_stays_open(spark):
    rows = [claim("s", "owned_by", "red", day(1), literal=True), claim("s", "owned_by", "blue", day(2), polarity=False, literal=True)]
    got = {r.object_literal: r.valid_to for r in temporal.supersede(frame(spark, *rows)).collect()}
    assert got["red"] is not None and got["blue"] is None


def test_sweep_closes_what_a_run_did_not_write(spark):
    df = frame(spark, claim("a", "caches_in", "redis", day(1), scope="k"), claim("a", "caches_in", "memcached", day(2), scope="k"), claim("b", "p", "x", day(1), scope="other"), claim("c", "p", "x", day(1)))
    run = "2024-01-02 00:00:00"
    assert [r.proposition_id for r in temporal.sweep(df, "k", run).collect()] == ["a|caches_in|redis"]
    assert [r[0] for r in temporal.swept_edges(df, "k", run).collect()] == ["a|caches_in|redis"]


def test_series_equals_single_instants(spark):
    df = frame(spark, *[claim(f"s{i % 5}", "p", f"o{i % 3}", day(1 + i % 9), ("human", "verifier", "telemetry")[i % 3], i % 4 != 0, 0.1 * (i % 10)) for i in range(60)])
    times = ["2024-01-03 00:00:00", "2024-01-09 12:00:00"]
    for row in temporal.asof_series(df, times).collect():
        at = row["at"].strftime("%Y-%m-%d %H:%M:%S")
        one = temporal.edges_at(df, at).agg(F.count(F.lit(1)), F.count_if(F.col("trust") == 0), F.round(F.avg("trust"), 6)).first()
        assert tuple(row)[1:] == tuple(one)


def test_trust_labels(spark):
    df = spark.createDataFrame([(0.7,), (0.4,), (0.15,), (0.1,)], "t double")
    assert [r[0] for r in df.select(trust_label(F.col("t"))).collect()] == ["high", "medium", "low", "very low"]


EDGE = "proposition_id string, subject string, predicate string, object string, object_literal string, trust double, via string"


def test_derived_edges_need_the_claim_they_hang_on(spark):
    base = spark.createDataFrame([("p1", "C", "reads_from", "cache", None, 0.9, None), ("p2", "B", "reads_from", "cache", None, 0.9, None)], EDGE)
    notes = spark.createDataFrame([("p1", "n1", "falls_back_to", "db", 0.8)], "subject_prop string, proposition_id string, predicate string, object string, trust double")
    all_edges = base.unionByName(graph.derived_edges(base, notes).withColumn("object_literal", F.lit(None).cast("string")))
    starts = spark.createDataFrame([("C",), ("B",)], "id string")
    found = {">".join(r.path) for r in graph.walk(all_edges, starts, ("reads_from", "falls_back_to"), (), 3).collect()}
    assert found == {"C>cache", "C>cache>db", "B>cache"}


def test_walk_goes_back_over_reverse_predicates_and_never_in_circles(spark):
    rows = [("p1", "client", "calls", "ep", None, 0.9, None), ("p2", "svc", "exposes_endpoint", "ep", None, 0.8, None), ("p3", "svc", "calls", "client", None, 0.9, None), ("p4", "svc", "reads_from", "db", None, 0.01, None)]
    paths = graph.walk(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("client",)], "id string"), ("calls", "reads_from"), ("exposes_endpoint",), 5).collect()
    assert {">".join(r.path): round(r.trust, 6) for r in paths} == {"client>ep": 0.9, "client>ep>svc": 0.72}


def test_prefixes_are_pruned(spark):
    paths = spark.createDataFrame([("a", ["a", "b"]), ("a", ["a", "b", "c"]), ("a", ["a", "x"]), ("a", ["a", "bb"])], "start string, path array<string>")
    assert sorted(">".join(r.path) for r in graph.prune_prefixes(paths).collect()) == ["a>b>c", "a>bb", "a>x"]


def test_canonical_chains_and_dangling_pointers(spark):
    rows = [(f"e{i}", f"e{i + 1}") for i in range(20)] + [("e20", "e20"), ("x", "gone"), ("y", None)]
    roots = dict(graph.canonical_map(spark.createDataFrame(rows, "id string, canonical_id string")).collect())
    assert all(roots[f"e{i}"] == "e20" for i in range(21)) and roots["x"] == "gone" and roots["y"] == "y"


def test_degree_counts_a_self_loop_once(spark):
    rows = [("p1", "a", "p", "a", None, 1.0, None), ("p2", "a", "p", "b", None, 1.0, None), ("p3", "c", "note", None, "text", 1.0, None)]
    assert dict(graph.degree(spark.createDataFrame(rows, EDGE)).collect()) == {"a": 2, "b": 1, "c": 1}


def test_cross_repo_edges_share_no_repo(spark):
    rows = [("l1", "a", "lives_in_repo", "r1", None, 1.0, None), ("l2", "b", "lives_in_repo", "r2", None, 1.0, None), ("l3", "c", "lives_in_repo", "r1", None, 1.0, None), ("l4", "c", "lives_in_repo", "r2", None, 1.0, None),
            ("x1", "a", "calls", "b", None, 1.0, None), ("x2", "a", "calls", "c", None, 1.0, None)]
    df = spark.createDataFrame(rows, EDGE)
    assert [tuple(r) for r in graph.cross_repo_edges(df, graph.entity_repo(df)).collect()] == [("x1", "r1", "r2")]


def test_endpoint_joins_by_route(spark):
    rows = [("web", "calls", "ep1", {"path": "/V1/n"}), ("svc", "exposes_endpoint", "ep2", {"path": "/v1/n", "method": "get"}), ("web", "calls", "ep3", {"path": "/v1/n", "method": "post"})]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, qualifiers map<string,string>")
    signatures = graph.endpoint_signatures(df, spark.createDataFrame([("ep1",), ("ep2",), ("ep3",)], "id string"))
    assert [tuple(r) for r in graph.endpoint_joins(df, signatures).collect()] == [("ep1", "ep2", "/v1/n", "GET", "svc")]


def test_most_valuable_kind_ranks_first(spark):
    paths = spark.createDataFrame([("a", ["a", "r"], ["p1"], 1, 0.9), ("a", ["a", "d"], ["p2"], 1, 0.3), ("a", ["a", "d"], ["p3"], 1, 0.2)], "start string, path array<string>, props array<string>, depth int, trust double")
    kinds = spark.createDataFrame([("a", "service"), ("r", "repo"), ("d", "datastore")], "id string, kind string")
    ranked = graph.ranked_paths(graph.best_kind(paths, kinds)).orderBy("rank").collect()
    assert [(r.path[-1], r.best_kind, r.trust) for r in ranked] == [("d", "datastore", 0.3), ("r", "repo", 0.9)]


def test_merges_can_be_taken_back(spark):
    entities = spark.createDataFrame([(c,) for c in "abcdxyz"], "id string")
    merges = [(1, "a", "b", day(1), None), (2, "b", "c", day(2), day(5)), (3, "d", "c", day(3), None), (4, "a", "d", day(4), None), (5, "x", "y", day(1), None), (6, "y", "z", day(1), None), (7, "z", "x", day(1), None), (8, "c", "a", day(1), None)]
    log = spark.createDataFrame(merges, "id long, from_id string, into_id string, merged_at timestamp, reverted_at timestamp")
    barred = spark.createDataFrame([(8,)], "id long")

    def roots(n):
        return {r.id: r.root for r in graph.roots_at(entities, log, barred, F.lit(day(n))).collect()}

    assert roots(1) == {"a": "b", "b": "b", "c": "c", "d": "d", "x": "x", "y": "x", "z": "x"}
    assert roots(3) == {"a": "c", "b": "c", "c": "c", "d": "c", "x": "x", "y": "x", "z": "x"}
    assert roots(6) == {"a": "c", "b": "b", "c": "c", "d": "c", "x": "x", "y": "x", "z": "x"}


@pytest.mark.parametrize("tail", [0, 1, 7])
def test_pointers_in_cycles_and_long_chains(spark, tail):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)] + [("c100", "c100"), ("n", None), ("o", "elsewhere"), (None, "n")]
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [(f"t{i}", f"t{i + 1}" if i + 1 < tail else "r3") for i in range(tail)]
    got = {r.id: r.root for r in graph.canonical_map(spark.createDataFrame(chain + ring, "id string, canonical_id string")).collect()}
    assert got == {f"c{i:03}": "c100" for i in range(101)} | {"n": "n", "o": "elsewhere"} | {f"r{i}": "r0" for i in range(5)} | {f"t{i}": "r0" for i in range(tail)}


def test_a_walk_by_the_best_paths_finds_the_best_of_all(spark):
    import random

    rnd = random.Random(7)
    nodes = [f"n{i}" for i in range(14)]
    rows = [(f"{a}|calls|{b}", a, "calls", b, None, round(rnd.random(), 3)) for a in nodes for b in nodes if a != b and rnd.random() < 0.3]
    df = spark.createDataFrame(rows, "proposition_id string, subject string, predicate string, object string, object_literal string, trust double")
    starts = spark.createDataFrame([(n,) for n in nodes[:3]], "id string")
    every = graph.walk(df, starts, ("calls",), depth=4)
    pruned = graph.walk(df, starts, ("calls",), depth=4, best=6)
    want, got = ([tuple(map(str, r)) for r in graph.first_paths(p, 6).select("start", "path", "depth").orderBy("start", "path").collect()] for p in (every, pruned))
    assert got == want and pruned.count() < every.count()


def _best(paths, n):
    rows = sorted(((r.start, -round(r.trust, 9), ">".join(r.path), ">".join(r.props)) for r in paths.collect()))
    nth = {}
    return [r for r in rows if nth.setdefault(r[0], []).append(r) or len(nth[r[0]]) <= n]


@pytest.mark.parametrize("most", [1.0, 1.14])
def test_a_walk_by_the_best_paths_keeps_equal_and_nearly_equal_steps_apart(spark, most):
    import random

    rnd = random.Random(11)
    nodes = [f"n{i}" for i in range(12)]
    worth = [most, 0.6, 0.6 - 1e-10, 0.6 - 4e-10, 0.3]
    rows = [(f"{a}|{p}|{b}", a, p, b, None, rnd.choice(worth)) for a in nodes for b in nodes for p in ("calls", "reads_from") if a != b and rnd.random() < 0.25]
    df = spark.createDataFrame(rows, "proposition_id string, subject string, predicate string, object string, object_literal string, trust double")
    starts = spark.createDataFrame([(n,) for n in [*nodes[:3], "alone"]], "id string")
    every = graph.walk(df, starts, ("calls", "reads_from"), depth=3)
    assert _best(graph.first_paths(graph.walk(df, starts, ("calls", "reads_from"), depth=3, best=4), 4), 4) == (_best(every, 4) if most == 1.0 else _best_by_length(every, 4))


def _best_by_length(paths, n):
    """As ``_best``, but only what continues one of the best of each length counts."""
    rows = sorted(((r.start, -round(r.trust, 9), ">".join(r.path), ">".join(r.props)) for r in paths.collect()))
    alive, kept = {(s,) for s, *_ in rows}, []
    for depth in range(1, 4):
        fit = [r for r in rows if r[2].count(">") == depth and (depth == 1 or (r[0], r[2].rsplit(">", 1)[0], r[3].rsplit(">", 1)[0]) in alive)]
        best = [r for i, r in enumerate(fit) if sum(x[0] == r[0] for x in fit[:i]) < n]
        alive, kept = {(r[0], r[2], r[3]) for r in best}, kept + best
    kept.sort()
    return [r for i, r in enumerate(kept) if sum(x[0] == r[0] for x in kept[:i]) < n]


def test_a_walk_writes_no_more_paths_than_a_start_can_show(spark, monkeypatch):
    hub = [(f"h|calls|t{i:03}", "h", "calls", f"t{i:03}", None, 0.9) for i in range(300)]
    into = [(f"s{i}|calls|h", f"s{i}", "calls", "h", None, 0.8) for i in range(30)]
    df = spark.createDataFrame(into + hub, "proposition_id string, subject string, predicate string, object string, object_literal string, trust double")
    written, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda d, *a, **k: written.append(settle(d, *a, **k)) or written[-1])
    paths = graph.walk(df, spark.createDataFrame([(f"s{i}",) for i in range(30)], "id string"), ("calls",), depth=2, best=8)
    assert paths.count() == 240 and {tuple(r.path[1:]) for r in paths.where("start = 's0'").collect()} == {("h",), *(("h", f"t{i:03}") for i in range(7))}
    lists = written[0].selectExpr("src", "size(steps) as n").collect()
    assert {r.src: r.n for r in lists}["h"] == 10  # of 300: best + depth


def test_a_walk_back_from_hot_things_lists_few_steps_and_forgets_its_shuffles(spark, monkeypatch):
    rows = [(f"s{i:03}|reads_from|p", f"s{i:03}", "reads_from", "p", None, 0.5 + i / 1000) for i in range(200)] + [(f"c|calls|s{i:03}", "c", "calls", f"s{i:03}", None, 0.9) for i in range(200)]
    df = spark.createDataFrame(rows, "proposition_id string, subject string, predicate string, object string, object_literal string, trust double")
    written, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda d, *a, **k: written.append((settle(d, *a, **k), k)) or written[-1][0])
    paths = graph.walk(df, spark.createDataFrame([("p",)], "id string"), (), ("reads_from", "calls"), depth=5, best=8)
    assert [">".join(r.path) for r in paths.orderBy(F.desc("trust")).collect()] == [f"p>s{i}" for i in range(199, 191, -1)]
    assert written[0][0].selectExpr("max(size(steps))").first()[0] <= 14 and all(k.get("tidy") for _, k in written)


def test_claims_of_one_assertion_are_edges_without_gathering(spark):
    from attesta.operators import temporal

    shape = "proposition_id string, subject string, predicate string, object string, object_literal string, polarity boolean, method string, confidence double, created_at timestamp"
    rows = [("a|calls|b", "a", "calls", "b", None, True, "code_derived", None, day(1)), ("a|calls|c", "a", "calls", "c", None, False, "human", None, day(1)), ("a|calls|d", "a", "calls", "d", None, True, "human", 0.5, day(9))]
    df = spark.createDataFrame(rows, shape)
    columns = ["proposition_id", "subject", "predicate", "object", "object_literal", "trust"]
    single = temporal.single_edges_at(df, F.lit(day(4)))
    assert single.collect() == temporal.edges_at(df, F.lit(day(4))).select(*columns).collect() and "Exchange" not in single._jdf.queryExecution().executedPlan().toString()


def test_a_walk_in_waves_over_tables_of_claims_finds_the_same_and_reads_one_large_table_at_a_time(spark, monkeypatch):
    from attesta.plans import claims

    def found():
        return sorted(map(tuple, claims.walk_blast_radius(spark, "/root/testdata/sf0.001").collect()))

    once, plans, settle = found(), [], graph.settle

    def kept(d, *a, **k):
        plans.append(d._jdf.queryExecution().optimizedPlan().toString())
        return settle(d, *a, **k)

    monkeypatch.setattr(graph, "settle", kept)
    monkeypatch.setattr(graph, "WAVE", 40)
    assert found() == once and len(once) > 0
    assert sorted(p.count("min(l_shipdate") for p in plans)[-2:] == [1, 1]  # those calling and those reading are written apart
    assert len(plans) >= 5 + 2 * graph.WAVES  # three tables of claims, the lists, the starts, and rounds of each wave
