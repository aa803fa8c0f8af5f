"""The graph of live claims: canonical edges, walks, repositories and endpoints."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.session import forget, settle

# Predicates that each kind of question follows, forwards and backwards, and how far.
TEMPLATES = {
    "data_provenance": {
        "forward": (
            "calls", "reads_from", "caches_in", "falls_back_to", "subscribes_to", "writes_to", "provisioned_by", "deployed_to",
            "lives_in_repo", "composes", "depends_on_package", "part_of", "variant_of",
        ),
        "reverse": ("exposes_endpoint", "publishes_to"),
        "depth": 7,
    },
    "blast_radius": {
        "forward": (),
        "reverse": (
            "calls", "reads_from", "writes_to", "caches_in", "subscribes_to", "publishes_to", "depends_on", "exposes_endpoint",
            "composes", "depends_on_package", "exports", "variant_of",
        ),
        "depth": 5,
    },
    "concept_map": {
        "forward": (
            "calls", "reads_from", "writes_to", "caches_in", "falls_back_to", "subscribes_to", "publishes_to", "exposes_endpoint",
            "provisioned_by", "deployed_to", "lives_in_repo",
        ),
        "reverse": ("implements", "handles_data", "exposes_endpoint", "composes", "exports"),
        "depth": 6,
    },
    "access": {"forward": ("connect_via", "secret_at", "provisioned_by", "deployed_to", "lives_in_repo"), "reverse": (), "depth": 3},
}
#: Starts that a wave of a walk has at least, where there are several, and the most waves; each reads the lists of steps anew.
WAVE, WAVES = 100_000, 4
# How much reaching a kind answers a question.
KIND_VALUE = {"datastore": 6, "cloud_resource": 5, "queue": 4, "cache": 3, "component": 3, "client": 3, "package": 2, "iac_module": 2, "repo": 1}


def canonical_map(entities: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root): where each entity's chain of canonical pointers ends.

    Pointers are followed two steps at a time (root of root), so rounds grow with the
    logarithm of the longest chain. An id without a row and a null pointer end the chain.
    Ids whose chain runs into a cycle get the smallest id from there on, which all ids of
    the cycle share. Of the tables that cut the lineage only the last stays.
    """
    first = F.coalesce("canonical_id", "id")
    step = settle(entities.where("id is not null").select("id", first.alias("root"), F.least("id", first).alias("low"), F.lit(True).alias("moved"), F.lit(True).alias("lower")))
    moving = None
    for _ in range(rounds):
        target = step.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("low").alias("next_low"))
        ahead = F.coalesce("next", "root")
        seen, joined = Observation(), step.join(target, "root", "left")
        after = settle(
            joined.select("id", ahead.alias("root"), F.least("low", "next_low").alias("low"), (F.col("root") != ahead).alias("moved"), F.coalesce(F.col("next_low") < F.col("low"), F.lit(False)).alias("lower"))
            .observe(seen, F.count_if("moved").alias("moved"), F.count_if(F.col("moved") & F.col("lower")).alias("lower"))
        )
        forget(step)
        step, now = after, seen.get["moved"]
        if not now:
            return step.select("id", "root")
        if now == moving and not seen.get["lower"]:  # chains with an end come to rest, so all that still moves is in a cycle or runs into one
            return step.select("id", F.when(F.col("moved"), F.col("low")).otherwise(F.col("root")).alias("root"))
        moving = now
    raise RuntimeError(f"canonical pointers weren't settled after {rounds} rounds")


def roots_at(entities: DataFrame, merges: DataFrame, barred: DataFrame, at: Column) -> DataFrame:
    """(id, root) of every entity at an instant, by a log of merges that may have been taken back.

    entities: id; merges: id, from_id, into_id, merged_at, reverted_at; barred: ids of merges
    that are void. A merge holds from its moment until it is reverted; of several of one
    entity the latest counts, then the larger id. What had followed a merge goes back with it.
    """
    held = merges.where((F.col("merged_at") <= at) & (F.col("reverted_at").isNull() | (F.col("reverted_at") > at)) & (F.col("from_id") != F.col("into_id"))).join(barred.select("id"), "id", "left_anti")
    latest = held.groupBy("from_id").agg(F.max_by("into_id", F.struct("merged_at", "id")).alias("canonical_id")).withColumnRenamed("from_id", "id")
    return canonical_map(entities.select("id").distinct().join(latest, "id", "left"))


def canonical_edges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between canonical entities; ends that aren't catalogued stay as they are."""
    ends = roots.select("id", "root")
    moved = (
        edges.join(ends.withColumnsRenamed({"id": "subject", "root": "s"}), "subject", "left")
        .join(ends.withColumnsRenamed({"id": "object", "root": "o"}), "object", "left")
    )
    return moved.select("proposition_id", F.coalesce("s", "subject").alias("subject"), "predicate", F.coalesce("o", "object").alias("object"), "object_literal", "trust")


def derived_edges(edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """Edges between the objects of a claim and of a claim about it, with the claim they hang on.

    annotations: subject_prop, proposition_id, predicate, object, trust. A walk may take such
    an edge only right after the claim ``via`` that it annotates.
    """
    parent = edges.select(F.col("proposition_id").alias("subject_prop"), F.col("object").alias("subject"))
    return annotations.where("object is not null").join(parent.where("subject is not null"), "subject_prop").select(
        "proposition_id", "subject", "predicate", "object", "trust", F.col("subject_prop").alias("via")
    )


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edges that touch a node; an edge from a node to itself counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array_compact(F.array("subject", "object")))).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hops(edges: DataFrame, forward: tuple[str, ...], reverse: tuple[str, ...], min_trust: float) -> DataFrame:
    """Directed steps that a template allows: (src, dst, proposition_id, trust, via)."""
    via = F.col("via") if "via" in edges.columns else F.lit(None).cast("string")
    kept = edges.where((F.col("trust") >= min_trust) & F.col("object").isNotNull())
    out = kept.where(F.col("predicate").isin(*forward)).select(F.col("subject").alias("src"), F.col("object").alias("dst"), "proposition_id", "trust", via.alias("via"))
    back = kept.where(F.col("predicate").isin(*reverse)).select(F.col("object").alias("src"), F.col("subject").alias("dst"), "proposition_id", "trust", via.alias("via"))
    return out.unionByName(back)


def walk(edges: DataFrame | list[DataFrame], starts: DataFrame, forward: tuple[str, ...], reverse: tuple[str, ...] = (), depth: int = 6, min_trust: float = 0.05, best: int | None = None) -> DataFrame:
    """Simple paths of at most ``depth`` steps from each start (column id).

    edges: one table, or several without a common claim, of which each is written on its own
    before a walk by the best paths, so the shuffles of only one lie on the disk.
    (start, node, depth, path, props, trust): trust is the product along the path. Each step
    is an equi-join on the frontier's nodes, so any number of starts is walked at once. With
    ``best`` each start's so many most trusted paths are found (``first_paths``), and hubs fan
    out no further than what can count. Without it all paths are found, and hubs multiply.
    """
    parts = [hops(e, forward, reverse, min_trust) for e in (edges if isinstance(edges, list) else [edges])]
    if best:
        return _best_walk(parts, starts, depth, min_trust, best)
    steps = settle(reduce(DataFrame.unionByName, parts))
    frontier = starts.select(
        F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.array("id").alias("path"), F.array().cast("array<string>").alias("props"), F.lit(1.0).alias("trust"), F.lit(None).cast("string").alias("last")
    )
    found = None
    for _ in range(depth):
        a, b = frontier.alias("a"), steps.alias("b")
        joined = a.join(b, (F.col("a.node") == F.col("b.src")) & ~F.array_contains(F.col("a.path"), F.col("b.dst")) & (F.col("b.via").isNull() | (F.col("b.via") == F.col("a.last"))))
        frontier = joined.select(
            "a.start", F.col("b.dst").alias("node"), (F.col("a.depth") + 1).alias("depth"), F.array_append("a.path", F.col("b.dst")).alias("path"),
            F.array_append("a.props", F.col("b.proposition_id")).alias("props"), (F.col("a.trust") * F.col("b.trust")).alias("trust"), F.col("b.proposition_id").alias("last"),
        )
        found = frontier if found is None else found.unionByName(frontier)
    return (frontier if found is None else found).drop("last")


def _step_lists(steps: DataFrame, depth: int, min_trust: float, best: int) -> DataFrame:
    """(src, via, steps): the steps from a node that can be among the ``best`` that continue a path, as one list.

    A path of at most ``depth`` nodes bars as many targets, so of a node's targets the first
    best + depth by trust leave enough; a target behind them counts only if its trust is so near that
    rounding the product with the least trust of a path makes it equal, and of equal ones the
    smaller target comes first. All claims between two nodes stay together.
    """
    enough = best + depth
    near = 1.001e-9 / min_trust ** (depth - 1) if min_trust > 0 else float("inf")
    node = ["src", "via"]
    top = steps.repartition("src").withColumn("top", F.max("trust").over(W.partitionBy(*node, "dst")))
    alike = top.withColumn("nth", F.dense_rank().over(W.partitionBy(*node, "top").orderBy("dst"))).where(F.col("nth") <= enough)
    if near < 1:
        ranked = alike.withColumn("nth", F.dense_rank().over(W.partitionBy(*node).orderBy(F.desc("top"), "dst")))
        last = F.coalesce(F.max(F.when(F.col("nth") == enough, F.col("top"))).over(W.partitionBy(*node)), F.lit(0.0))
        alike = ranked.withColumn("least", last - F.lit(near)).where(F.col("top") >= F.col("least"))
    return alike.groupBy(*node).agg(F.collect_list(F.struct("trust", "dst", F.col("proposition_id").alias("prop"))).alias("steps"))


def _best_walk(parts: list[DataFrame], starts: DataFrame, depth: int, min_trust: float, best: int) -> DataFrame:
    """Each start's ``best`` most trusted paths, ties as in ``first_paths``.

    Where no step raises trust a path is worse than all its beginnings, so only what is among
    a start's best of all lengths so far goes on: the nth of them by its best - n best steps,
    and by none that is worse than the last of ``best``. Where a step's trust is over 1, the best of each length go on.
    Many starts are walked in waves, one after the other, so only the shuffles of a wave lie on the disk.
    """
    seen, many = Observation(), Observation()
    written = [settle(p, tidy=True) for p in parts] if len(parts) > 1 else []
    steps = reduce(DataFrame.unionByName, written or parts)
    lists = settle(_step_lists(steps, depth, min_trust, best).observe(seen, F.max(F.array_max(F.transform("steps", lambda s: s["trust"]))).alias("trust"), F.count_if(F.col("via").isNotNull()).alias("hung")), tidy=True)
    forget(*written)
    falling, hung = (seen.get["trust"] or 0.0) <= 1.0, seen.get["hung"]
    starts = settle(starts.select("id").observe(many, F.count(F.lit(1)).alias("starts")), tidy=True)
    waves = min(WAVES, max(1, math.ceil(many.get["starts"] / WAVE)))
    walked = [_rounds(lists, starts.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == k), depth, best, falling, hung) for k in range(waves)]
    state = reduce(DataFrame.unionByName, walked)
    return (state if falling else first_paths(state.drop("nth"), best)).select("start", "node", "depth", "path", "props", "trust")


def _rounds(lists: DataFrame, starts: DataFrame, depth: int, best: int, falling: bool, hung: int) -> DataFrame:
    """The paths that go on or stay among the best of these starts, after all rounds, as a table of ``settle``."""
    free, after = (lists.where(F.col("via").isNull() == nothing).select(F.col("src").alias("node"), F.col("via").alias("last"), "steps") for nothing in (True, False))
    group = ["start"] if falling else ["start", "depth"]
    own = ["start", "node", "depth", "path", "props", "trust", "last"]
    state = starts.select(
        F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.array("id").alias("path"), F.array().cast("array<string>").alias("props"), F.lit(1.0).alias("trust"), F.lit(None).cast("string").alias("last"),
        F.lit(0).alias("nth"), F.lit(None).cast("double").alias("least"),
    )
    for n in range(depth):
        ahead = state.where(F.col("depth") == n).join(free.drop("last"), "node", "left")
        if hung:
            ahead = ahead.join(after.withColumnRenamed("steps", "more"), ["node", "last"], "left").withColumn("steps", F.when(F.col("more").isNull(), F.col("steps")).otherwise(F.concat(F.coalesce("steps", F.slice("more", 1, 0)), "more")))
        left = F.greatest(F.lit(best) - F.col("nth"), F.lit(0)) if falling else F.lit(best)
        product = lambda s: F.round(F.col("trust") * s["trust"], 9)
        able = F.filter("steps", lambda s: ~F.array_contains("path", s["dst"]) & (F.col("least").isNull() | (product(s) >= F.col("least"))))
        ordered = F.array_sort(F.transform(able, lambda s: F.struct((-product(s)).alias("down"), s["dst"].alias("dst"), s["prop"].alias("prop"), s["trust"].alias("trust"))))
        ahead = ahead.select(*own, F.transform(F.slice(ordered, 1, left), lambda s: F.struct(s["dst"].alias("dst"), s["prop"].alias("prop"), s["trust"].alias("trust"))).alias("steps"))
        if n:
            ahead = ahead.unionByName(state.where(F.col("depth") < n).select(*own), allowMissingColumns=True)
        itself = F.array(F.lit(None).cast(ahead.schema["steps"].dataType.elementType))
        one = ahead.repartition("start").select(*own, F.explode(F.coalesce(F.concat(itself, "steps"), itself)).alias("s"))
        on = F.col("s").isNotNull()
        paths = one.select(
            "start", F.coalesce("s.dst", "node").alias("node"), F.when(on, n + 1).otherwise(F.col("depth")).alias("depth"), F.when(on, F.array_append("path", F.col("s.dst"))).otherwise(F.col("path")).alias("path"),
            F.when(on, F.array_append("props", F.col("s.prop"))).otherwise(F.col("props")).alias("props"), F.when(on, F.col("trust") * F.col("s.trust")).otherwise(F.col("trust")).alias("trust"), F.coalesce("s.prop", "last").alias("last"),
        ).where("depth > 0")
        kept = paths.withColumn("nth", F.row_number().over(W.partitionBy(*group).orderBy(*_trusted()))).where(F.col("nth") <= best)
        least = F.max(F.when(F.col("nth") == best, F.round("trust", 9))).over(W.partitionBy(*group)) if falling else F.lit(None).cast("double")
        before, state = state, settle(kept.withColumn("least", least), tidy=True)
        if n:
            forget(before)
        if n + 1 == depth or state.where(F.col("depth") == n + 1).join(lists.select(F.col("src").alias("node")), "node", "left_semi").isEmpty():
            break
    return state


def _trusted() -> list[Column]:
    """The order of paths: the most trusted first; ties go to the smaller path string, then to the smaller claims."""
    return [F.desc(F.round("trust", 9)), F.concat_ws(">", "path"), F.concat_ws(">", "props")]


def first_paths(paths: DataFrame, limit: int) -> DataFrame:
    """Each start's most trusted paths; ties go to the smaller path string, then to the smaller claims."""
    return paths.withColumn("nth", F.row_number().over(W.partitionBy("start").orderBy(*_trusted()))).where(F.col("nth") <= limit).drop("nth")


def top_paths(paths: DataFrame, limit: int = 500) -> DataFrame:
    """The most trusted paths; ties go to the smaller path string."""
    return paths.orderBy(F.desc(F.round("trust", 9)), F.concat_ws(">", "path")).limit(limit)


def best_kind(paths: DataFrame, kinds: DataFrame) -> DataFrame:
    """``paths`` with the most valuable kind on the way and its value; kinds: id, kind.

    Of kinds with equal value the one met first counts; where none has a value, none.
    """
    worth = F.lit(0)
    for kind, value in KIND_VALUE.items():
        worth = F.when(F.col("kind") == kind, value).otherwise(worth)
    keyed = paths.withColumn("line", F.concat_ws(">", "path"))
    nodes = keyed.select("line", F.posexplode("path").alias("at", "id")).join(kinds.select("id", "kind"), "id").withColumn("worth", worth).where("worth > 0")
    best = nodes.groupBy("line").agg(F.max_by(F.struct("kind", "worth"), F.struct("worth", -F.col("at"))).alias("best"))
    return keyed.join(best, "line", "left").select(*paths.columns, F.col("best.kind").alias("best_kind"), F.coalesce("best.worth", F.lit(0)).alias("best_value"))


def ranked_paths(paths: DataFrame) -> DataFrame:
    """The best path of each node sequence, in order: most valuable kind, then trust in steps of
    two hundredths, then depth, then the path itself.

    The order that this stands for compares trust with a tolerance and so is no order at
    all (it isn't transitive); steps of the tolerance's size make it one.
    """
    line = F.concat_ws(">", "path")
    order = [F.desc("best_value"), F.desc(F.floor(F.round(F.col("trust") / 0.02, 6))), F.desc("depth"), F.desc(F.round("trust", 9)), F.concat_ws(">", "props")]
    first = paths.withColumn("nth", F.row_number().over(W.partitionBy("start", line).orderBy(*order))).where("nth = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("start").orderBy(*order[:-1], line))).drop("nth")


def hydrate(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, line, at, proposition_id, subject, predicate, object, step_trust, support_count, refute_count): the steps of each path.

    Paths carry ids only while they are walked; what the steps say is joined on afterwards.
    Counts are of assertions, not of their evidence.
    """
    steps = paths.select("start", F.concat_ws(">", "path").alias("line"), F.posexplode("props").alias("at", "proposition_id"))
    said = edges.select("proposition_id", "subject", "predicate", "object", F.col("trust").alias("step_trust"), "support_count", "refute_count")
    return steps.join(said, "proposition_id").select("start", "line", "at", "proposition_id", "subject", "predicate", "object", "step_trust", "support_count", "refute_count")


def prune_prefixes(paths: DataFrame) -> DataFrame:
    """Paths that no longer path of the same start begins with.

    Every proper prefix of a path is listed and taken off by an anti-join, so no two paths
    are ever compared.
    """
    whole = paths.withColumn("line", F.concat_ws(">", "path"))
    lengths = F.sequence(F.lit(2), F.greatest(F.size("path") - 1, F.lit(2)))
    shorter = whole.where(F.size("path") > 2).select(F.explode(F.transform(lengths, lambda n: F.concat_ws(">", F.slice("path", 1, n)))).alias("line")).distinct()
    return whole.join(shorter, "line", "left_anti").drop("line")


def facts(edges: DataFrame) -> DataFrame:
    """(subject, predicate, value, trust) of claims with a plain value, over-refuted ones included."""
    return edges.where("object_literal is not null").select("subject", "predicate", F.col("object_literal").alias("value"), "trust")


def entity_repo(edges: DataFrame) -> DataFrame:
    """(id, repo): where things live, or what they belong to lives, one step on."""
    lives = edges.where("predicate = 'lives_in_repo'").select(F.col("subject").alias("id"), F.col("object").alias("repo"))
    holds = edges.where("predicate = 'contains_project'").select(F.col("object").alias("id"), F.col("subject").alias("repo"))
    direct = lives.union(holds).where("id is not null and repo is not null").distinct()
    served = edges.where("predicate = 'exposes_endpoint'").select(F.col("object").alias("id"), F.col("subject").alias("home"))
    owned = edges.where(F.col("predicate").isin("provisioned_by", "part_of")).select(F.col("subject").alias("id"), F.col("object").alias("home"))
    inherited = served.union(owned).join(direct.withColumnRenamed("id", "home"), "home").select("id", "repo")
    return direct.union(inherited).distinct()


def cross_repo_edges(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """(proposition_id, subject_repo, object_repo) of edges whose ends share no repository.

    Each thing's repositories are gathered once; ends are compared before their product is formed.
    """
    link = edges.where(~F.col("predicate").isin("lives_in_repo", "contains_project") & F.col("object").isNotNull()).select("proposition_id", "subject", "object")
    held = homes.groupBy("id").agg(F.collect_set("repo").alias("repos"))
    ends = link.join(held.withColumnsRenamed({"id": "subject", "repos": "subject_repos"}), "subject").join(held.withColumnsRenamed({"id": "object", "repos": "object_repos"}), "object")
    apart = ends.where(~F.arrays_overlap("subject_repos", "object_repos"))
    pairs = apart.select("proposition_id", F.explode("subject_repos").alias("subject_repo"), "object_repos")
    return pairs.select("proposition_id", "subject_repo", F.explode("object_repos").alias("object_repo")).distinct()


def endpoint_signatures(edges: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(id, path, method) of endpoints, from any edge that names a route.

    edges: subject, object and a map ``qualifiers``; endpoints: id.
    """
    named = edges.where(F.map_contains_key("qualifiers", "path")).select(
        F.coalesce("object", "subject").alias("id"), F.lower(F.col("qualifiers")["path"]).alias("path"), F.upper(F.coalesce(F.col("qualifiers")["method"], F.lit("GET"))).alias("method")
    )
    return named.join(endpoints.select("id").distinct(), "id", "left_semi").distinct()


def endpoint_joins(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """Routes called in one place and served in another: (called, served, path, method, served_by)."""
    calls = edges.where("predicate = 'calls'").select(F.col("object").alias("id")).distinct()
    serves = edges.where("predicate = 'exposes_endpoint'").select(F.col("object").alias("id"), F.col("subject").alias("served_by"))
    called = signatures.join(calls, "id", "left_semi").join(serves.select("id").distinct(), "id", "left_anti").withColumnRenamed("id", "called")
    served = signatures.join(serves, "id").withColumnRenamed("id", "served")
    return called.join(served, ["path", "method"]).where("called <> served").select("called", "served", "path", "method", "served_by").distinct()
