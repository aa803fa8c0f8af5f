"""Queries over the entity catalogue: resolution, repairs and gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import kind_family, norm_name
from attesta.operators import gaps, graph, resolve, temporal
from attesta.plans import sql
from attesta.plans.claims import CATALOGUE_AT, ROOTS, ROUTES, endpoint_joins, endpoint_signatures
from attesta.session import settle
from attesta.sources import projection
from attesta.sources.tables import keyed
from attesta.sources.vocabulary import ENVIRONMENTLESS, KIND_FAMILIES


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return keyed(spark, folder, "entity", "id", "canonical_id", "kind", "env", "display_name", "provisional")


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    return keyed(spark, folder, "mention", "mention_id", "raw", "kind", "env", "scope", "identifiers")


def _proposals(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyed(spark, folder, "merge_candidate", "id", "from_id", "into_id", "resolution")
    verdict = F.lower(F.regexp_replace("resolution", r"^\s+|\s+$", ""))
    return rows.select("id", projection.entity_id(F.col("from_id")).alias("subject"), projection.entity_id(F.col("into_id")).alias("object"), verdict.alias("verdict")).where("subject is not null and object is not null")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = temporal.edges_at(projection.catalogue_claims(spark, folder), CATALOGUE_AT)
    return graph.canonical_edges(edges, graph.canonical_map(_entities(spark, folder)))


def _identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """What mentions that name an entity exactly say about its identifiers."""
    mentions = _mentions(spark, folder)
    return _said(mentions, resolve.alias_matches(mentions, _entities(spark, folder)))


def _said(mentions: DataFrame, matched: DataFrame) -> DataFrame:
    said = mentions.select("mention_id", F.explode("identifiers").alias("i")).join(matched, "mention_id")
    return said.select("id", F.lower(F.regexp_replace("i.authority", "[^A-Za-z0-9]+", "_")).alias("authority"), F.trim("i.value").alias("value")).where("authority is not null and value <> ''").distinct()


def name_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return _mentions(spark, folder).select("mention_id", norm_name(F.col("raw")).alias("name_norm"))


def kind_families(spark: SparkSession, folder: str) -> DataFrame:
    return _entities(spark, folder).groupBy("kind", kind_family(F.col("kind")).alias("family")).agg(F.count(F.lit(1)).alias("entities"))


def alias_match(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.alias_matches(_mentions(spark, folder), _entities(spark, folder)).select("mention_id", "id")


def strong_match(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.strong_matches(_mentions(spark, folder), _identifiers(spark, folder))


def minted(spark: SparkSession, folder: str) -> DataFrame:
    """What the mentions that no rung of the ladder resolves would mint."""
    return _minted(settle(_mentions(spark, folder), tidy=True), settle(_entities(spark, folder), tidy=True))


def _minted(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """mentions, entities: tables that each step may read again. What several steps need is written once, so plans stay small."""
    matched = settle(resolve.alias_matches(mentions, entities), tidy=True)
    strong = settle(resolve.strong_matches(mentions, _said(mentions, matched)), tidy=True)
    resolved = strong.select("mention_id").union(matched.select("mention_id"))
    return resolve.mintable(mentions, resolved).select("entity_id", "env", "name_norm", "kind", "mentions")


def dice_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.near_names(_entities(spark, folder))


def duplicate_names(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds by how many names several canonical entities share."""
    shared = resolve.names(_entities(spark, folder)).groupBy("kind", "name_norm").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.groupBy("kind").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("entities"), F.max("n").alias("most"))


def repair_merges(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.repairs(_entities(spark, folder), graph.degree(_edges(spark, folder)))


def barred_merges(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.barred_merges(_proposals(spark, folder), _entities(spark, folder))


def strong_id_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of canonical entities of each kind that have a strong identifier."""
    held = _identifiers(spark, folder).select("id").distinct().withColumn("held", F.lit(1))
    rows = _entities(spark, folder).where("canonical_id = id").join(held, "id", "left")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.count("held").alias("identified"), F.round(F.count("held") / F.count(F.lit(1)), 3).alias("coverage"))


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    return gaps.scored(gaps.gaps(_entities(spark, folder), settle(_edges(spark, folder)), _proposals(spark, folder), _identifiers(spark, folder), settle(endpoint_joins(spark, folder).select("called", "served").distinct())))


def gaps_all(spark: SparkSession, folder: str) -> DataFrame:
    return _gaps(spark, folder)


def auto_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Open proposals between endpoints with different routes, which need no question."""
    return resolve.different_routes(_proposals(spark, folder), endpoint_signatures(spark, folder))


def _aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Names of entities anywhere, and in a scope what mentions with a strong identifier call them there."""
    mentions = _mentions(spark, folder)
    strong = resolve.strong_matches(mentions, _identifiers(spark, folder))
    local = mentions.join(strong, "mention_id").select("id", norm_name(F.col("raw")).alias("name_norm"), "scope").where("name_norm <> ''")
    return resolve.names(_entities(spark, folder)).select("id", "name_norm", F.lit(None).cast("string").alias("scope")).union(local).distinct()


def ranked_match(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.ranked_matches(_mentions(spark, folder), _aliases(spark, folder), _entities(spark, folder))


def fuzzy_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """For each name that mentions would mint the entity most like it."""
    entities = settle(_entities(spark, folder), tidy=True)
    return resolve.proposals(_minted(settle(_mentions(spark, folder), tidy=True), entities), entities).select("entity_id", "id", F.round("score", 6).alias("score"))


def merged_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Which entities the confirmed merges have led to another one by an instant, unless they are barred."""
    rows = keyed(spark, folder, "merge_candidate", "id", "from_id", "into_id", "resolved_at", "resolution")
    verdict = F.lower(F.regexp_replace("resolution", r"^\s+|\s+$", ""))
    merges = rows.where(verdict == "merged").select("id", projection.entity_id(F.col("from_id")).alias("from_id"), projection.entity_id(F.col("into_id")).alias("into_id"), F.col("resolved_at").alias("merged_at"), F.lit(None).cast("timestamp").alias("reverted_at"))
    asked = _proposals(spark, folder).withColumn("verdict", F.when(F.col("verdict") == "merged", F.lit(None).cast("string")).otherwise(F.col("verdict"))).where("verdict is null or verdict = 'distinct'")
    barred = resolve.barred_merges(asked, _entities(spark, folder))
    return graph.roots_at(_entities(spark, folder), merges.where("from_id is not null and into_id is not null"), barred, F.to_timestamp(F.lit("2030-01-01"))).where("id <> root")


def graph_totals(spark: SparkSession, folder: str) -> DataFrame:
    """How many nodes and edges there are."""
    edges = _edges(spark, folder).agg(F.count(F.lit(1)).alias("edges"))
    return _entities(spark, folder).where("canonical_id = id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("provisional").alias("provisional")).crossJoin(edges)  # one row each


def latest_assertions(spark: SparkSession, folder: str) -> DataFrame:
    """The latest assertion of each claim about the catalogue."""
    rows = projection.catalogue_claims(spark, folder)
    newest = rows.groupBy("proposition_id").agg(F.max(F.struct("created_at", "method", "polarity", "confidence")).alias("r"))
    return newest.select("proposition_id", F.date_format("r.created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("said"), "r.method", "r.polarity")


def gap_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _gaps(spark, folder).groupBy("kind", "entity_kind").agg(F.count(F.lit(1)).alias("gaps"), F.max("score").alias("best"))


def gaps_askable(spark: SparkSession, folder: str) -> DataFrame:
    """The two best questions near the team entities: a report of the top two."""
    near = _entities(spark, folder).where("kind = 'service'").select("id")
    return gaps.askable(_gaps(spark, folder), near).select("kind", "id", "score", "near")


def merge_review(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred best open proposals, by score."""
    rows = keyed(spark, folder, "merge_candidate", "id", "from_id", "into_id", "score", "resolution").where("resolution is null and score is not null")
    return rows.orderBy(F.desc("score"), "id").limit(100).select("id", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            name_normalise, kind_families, alias_match, strong_match, minted, dice_candidates, duplicate_names, repair_merges, barred_merges, strong_id_coverage, gaps_all, gap_counts, gaps_askable, merge_review, auto_distinct, ranked_match, fuzzy_proposals,
            merged_roots, graph_totals, latest_assertions,
        )
    }


def norm(c: str) -> str:
    lower = f"lower({c})"
    for pattern, by in ((r"^\s+|\s+$", ""), (r"[\s_]+", "-"), (r"[^a-z0-9.\-/]", ""), ("-+", "-"), ("^-|-$", "")):
        lower = f"regexp_replace({lower}, '{pattern}', '{by}', 'g')"
    return lower


def env(kind: str = "kind", of: str = "env") -> str:
    return f"case when {kind} in ({', '.join(repr(k) for k in ENVIRONMENTLESS)}) then 'unknown' else lower(coalesce({of}, 'unknown')) end"


def family(kind: str) -> str:
    return f"case {' '.join(f'when {kind} in ({", ".join(repr(m) for m in members)}) then {name!r}' for name, members in KIND_FAMILIES.items())} else {kind} end"


MENTIONS = "mentions as (select distinct on (mention_id) * from mention)"
NAMES = f"names as (select id, kind, {env()} as env, {norm('display_name')} as name_norm from entity where canonical_id = id and {norm('display_name')} <> '')"
MATCHED = f"""{MENTIONS}, {NAMES},
asked as (select mention_id, kind as asked_kind, {env()} as asked_env, {norm('raw')} as name_norm from mentions where {norm('raw')} <> ''),
envs as (select name_norm, count(distinct env) filter (where env <> 'unknown') as real_envs from names group by 1),
matched as (
  select mention_id, id from asked join names n using (name_norm) join envs using (name_norm)
  where (asked_env = env or asked_env = 'unknown' and real_envs <= 1) and (asked_kind is null or {family('asked_kind')} = {family('kind')})
  qualify row_number() over (partition by mention_id order by case when asked_kind = kind then 0 else 1 end, id) = 1)"""
SAID = r"""said as (select mention_id, lower(regexp_replace(i.authority, '[^A-Za-z0-9]+', '_', 'g')) as authority, trim(i.value) as value from (select mention_id, unnest(identifiers) as i from mentions)),
identifiers as (select distinct id, authority, value from said join matched using (mention_id) where authority is not null and value <> ''),
strong as (select mention_id, min(h.id) as id from said join (select authority, value, min(id) as id from identifiers group by all) h using (authority, value) group by 1)"""
CANON = f"""{ROOTS}, canon as (select proposition_id, coalesce(s.root, subject) as subject, predicate, coalesce(o.root, object) as object from edges left join roots s on s.id = subject left join roots o on o.id = object),
degrees as (select id, count(*) as degree from (select subject as id, proposition_id from canon union select object, proposition_id from canon where object is not null) group by id)"""
PROPOSALS = f"""proposals as (select id, subject, object, verdict, least(subject, object) as x, greatest(subject, object) as y from (
  select distinct on (id) id, {sql.entity_id('from_id')} as subject, {sql.entity_id('into_id')} as object, lower(trim(resolution, ' ' || chr(9) || chr(10) || chr(13))) as verdict from merge_candidate) where subject is not null and object is not null)"""


def oracle_sql() -> dict[str, str]:
    grams = "list_distinct(list_transform(range(1, length(name_norm)), lambda i: substr(name_norm, i, 2)))"
    tech = ", ".join(f"'{t}'" for t in gaps.TECHNOLOGY)
    base = " ".join(f"when '{k}' then {v}" for k, v in gaps.BASE.items())
    no = "id not in (select {0} from canon where {0} is not null and predicate in ({1}))"
    found = sql.edges(sql.CATALOGUE_CLAIMS, CATALOGUE_AT) + f""", {CANON}, {MATCHED}, {SAID}, {PROPOSALS}, {ROUTES},
served as (select s.id as served, s.path, s.method from signatures s join edges e on e.object = s.id and e.predicate = 'exposes_endpoint'),
called as (select s.id as called, s.path, s.method from signatures s where s.id in (select object from edges where predicate = 'calls') and s.id not in (select object from edges where predicate = 'exposes_endpoint')),
joined as (select distinct called, served from called join served using (path, method) where called <> served),
live_entities as (select e.id, kind as entity_kind, display_name as name, provisional, coalesce(degree, 0) as connectivity from entity e left join degrees d on d.id = e.id where canonical_id = e.id),
found as (
  select 'dangling_endpoint' as kind, * from live_entities where entity_kind = 'endpoint' and id in (select object from canon where predicate = 'calls') and {no.format('object', "'exposes_endpoint'")}
  union all select 'homeless_project', * from live_entities where entity_kind in ('client', 'service', 'iac_module') and {no.format('subject', "'lives_in_repo'")}
  union all select 'no_access_info', * from live_entities where entity_kind in ('datastore', 'cache', 'queue') and {no.format('subject', "'connect_via'")}
  union all select 'unknown_technology', * from live_entities where entity_kind in ('client', 'service') and {no.format('subject', tech)}
  union all select 'unprovisioned_infra', * from live_entities where entity_kind in ('datastore', 'cache', 'queue', 'cloud_resource') and {no.format('subject', "'provisioned_by'")}
  union all select 'undescribed_concept', * from live_entities where entity_kind in ('capability', 'data_concept') and {no.format('subject', "'note'")}
  union all select 'unidentified_entity', * from live_entities where provisional and connectivity >= 2 and id not in (select id from identifiers)
  union all select 'orphan_entity', * from live_entities where connectivity = 0 and entity_kind <> 'technology'
  union all select 'name_collision', l.* from (select distinct subject, object from proposals where verdict is null and (x, y) not in (select (x, y) from proposals where verdict = 'distinct') and (x, y) not in (select (least(called, served), greatest(called, served)) from joined)) p join live_entities l on l.id = p.subject),
flagged as (select *, kind = 'dangling_endpoint' and id in (select called from joined) as suggested from found),
gaps as (select kind, id, name, entity_kind, connectivity, suggested, round(case kind {base} end * (1 + least(connectivity, 8) * 0.04) * case when suggested then {gaps.SUGGESTED} else 1 end, 3)::double as score from flagged)"""
    return {
        "name_normalise": f"with {MENTIONS} select mention_id, {norm('raw')} as name_norm from mentions",
        "kind_families": f"select kind, {family('kind')} as family, count(*) as entities from entity group by kind",
        "alias_match": f"with {MATCHED} select mention_id, id from matched",
        "strong_match": f"with {MATCHED}, {SAID} select mention_id, id from strong",
        "minted": f"""with {MATCHED}, {SAID},
unmet as (select mention_id, kind, {family("coalesce(kind, 'thing')")} as family, {env()} as env, {norm('raw')} as name_norm from mentions where mention_id not in (select mention_id from matched union select mention_id from strong))
select sha256(name_norm || '|' || env || '|' || family) as entity_id, env, name_norm, arg_min_null(kind, mention_id) as kind, count(*) as mentions from unmet where name_norm <> '' group by name_norm, env, family""",
        "dice_candidates": f"""with {NAMES}, d as (select kind, env, name_norm, min(id) as id, {grams} as g from names group by kind, env, name_norm)
select a.id as a, b.id as b, a.kind, a.env, a.name_norm as name_a, b.name_norm as name_b, round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6)::double as score
from d a join d b on a.kind = b.kind and a.env = b.env and a.name_norm < b.name_norm where score >= 0.7""",
        "duplicate_names": f"with {NAMES} select kind, count(*) as names, sum(n)::bigint as entities, max(n) as most from (select kind, name_norm, count(*) as n from names group by all having n > 1) group by kind",
        "repair_merges": sql.edges(sql.CATALOGUE_CLAIMS, CATALOGUE_AT) + f""", {CANON},
named as (select e.*, {norm('display_name')} as name_norm, coalesce(degree, 0) as degree from entity e left join degrees d on d.id = e.id where canonical_id = e.id and {norm('display_name')} <> ''),
sized as (select *, count(*) over w as size, first_value(id) over (w order by degree desc, coalesce(provisional, false), id) as into_id from named window w as (partition by kind, name_norm)),
real_envs as (select kind, name_norm, count(distinct env) filter (where env <> 'unknown') as envs from named group by all)
select id as from_id, into_id from sized join real_envs using (kind, name_norm) where size > 1 and envs <= 1 and id <> into_id""",
        "barred_merges": f"""with {PROPOSALS}, envs as (select id, {env()} as env from entity),
sides as (select p.id, (x, y) in (select (x, y) from proposals where verdict = 'distinct') as known, a.env as env_a, b.env as env_b from proposals p left join envs a on a.id = subject left join envs b on b.id = object where verdict is null)
select id, case when known then 'distinct' else 'environments' end as reason from sides where known or env_a <> env_b and env_a <> 'unknown' and env_b <> 'unknown'""",
        "strong_id_coverage": f"""with {MATCHED}, {SAID}
select kind, count(*) as entities, count(*) filter (where id in (select id from identifiers)) as identified, round(count(*) filter (where id in (select id from identifiers)) / count(*), 3) as coverage from entity where canonical_id = id group by kind""",
        "gaps_all": found + " select * from gaps",
        "gap_counts": found + " select kind, entity_kind, count(*) as gaps, max(score) as best from gaps group by kind, entity_kind",
        "gaps_askable": found + """
select kind, id, score, id in (select id from entity where kind = 'service') as near from (select * from gaps where score >= 0.5 qualify row_number() over (partition by id order by score desc, kind) = 1) order by near desc, score desc, kind, id limit 2""",
        "auto_distinct": sql.edges(sql.CATALOGUE_CLAIMS, CATALOGUE_AT) + f""", {PROPOSALS}, {ROUTES}
select distinct p.id, x as a, y as b from proposals p join signatures s on s.id = subject join signatures o on o.id = object where verdict is null and (s.path is distinct from o.path or s.method is distinct from o.method)""",
        "ranked_match": f"""with {MATCHED}, {SAID},
aliases as (select id, name_norm, null as scope from names union select id, {norm('raw')}, scope from mentions join strong using (mention_id) where {norm('raw')} <> ''),
wanted as (select mention_id, scope, kind as asked_kind, {env()} as asked_env, {norm('raw')} as name_norm from mentions where {norm('raw')} <> ''),
hits as (select mention_id, asked_kind, asked_env, a.id, bool_or(a.scope is not distinct from w.scope) as scoped from wanted w join aliases a using (name_norm) group by all),
fit as (select h.*, e.kind, {env('e.kind', 'e.env')} as found_env from hits h join entity e on e.id = h.id and e.canonical_id = e.id where asked_kind is null or {family('asked_kind')} = {family('e.kind')}),
fitting as (select * from fit where asked_env = found_env or asked_env = 'unknown' or found_env = 'unknown'),
counted as (select *, (select count(distinct g.found_env) from fitting g where g.mention_id = f.mention_id and g.found_env <> 'unknown') as envs from fitting f)
select mention_id, id, case when scoped then 'alias_scoped' else 'alias_global' end as rung from counted where asked_env <> 'unknown' or envs <= 1
qualify row_number() over (partition by mention_id order by coalesce(asked_kind = kind, false) desc, asked_env = found_env desc, scoped desc, id) = 1""",
        "fuzzy_proposals": f"""with {MATCHED}, {SAID},
unmet as (select mention_id, kind, {family("coalesce(kind, 'thing')")} as family, {env()} as env, {norm('raw')} as name_norm from mentions where mention_id not in (select mention_id from matched union select mention_id from strong)),
minted as (select sha256(name_norm || '|' || env || '|' || family) as entity_id, env, name_norm, arg_min_null(kind, mention_id) as kind from unmet where name_norm <> '' group by name_norm, env, family),
m as (select *, {grams} as g from minted), n as (select *, {grams} as g from names),
scores as (select entity_id, n.id, case when m.name_norm = n.name_norm then 1.0::double else round(2.0 * len(list_intersect(m.g, n.g)) / nullif(len(m.g) + len(n.g), 0), 6)::double end as score
  from m join n on m.env = n.env and (m.kind is null or m.kind = n.kind))
select entity_id, id, score from scores where score >= 0.7 qualify row_number() over (partition by entity_id order by score desc, id) = 1""",
        "graph_totals": sql.edges(sql.CATALOGUE_CLAIMS, CATALOGUE_AT) + " select (select count(*) from entity where canonical_id = id) as nodes, (select count(*) from entity where canonical_id = id and provisional) as provisional, (select count(*) from edges) as edges",
        "latest_assertions": f"with {sql.CATALOGUE_CLAIMS} select proposition_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') as said, method, polarity from claims qualify row_number() over (partition by proposition_id order by created_at desc, method desc nulls last, polarity desc, confidence desc nulls last) = 1",
        "merge_review": "select id, score from (select distinct on (id) * from merge_candidate) where resolution is null and score is not null order by score desc, id limit 100",
    }
