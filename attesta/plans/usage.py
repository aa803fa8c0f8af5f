"""Queries over usage: reports, qualifiers, vectors and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import graph, ingest, report, similar
from attesta.plans import sql
from attesta.plans.activity import STRETCHES
from attesta.plans.catalogue import CANON, _edges
from attesta.plans.claims import CATALOGUE_AT
from attesta.session import settle
from attesta.sources import projection
from attesta.sources.tables import keyed, table
from attesta.sources.vocabulary import IDENTIFYING, predicate_rows
from attesta.streaming import activity as streams


def _activity(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return keyed(spark, folder, "activity", "id", *columns)


def usage_by_tool(spark: SparkSession, folder: str) -> DataFrame:
    return report.usage_by_tool(_activity(spark, folder, "source", "tool", "ok", "duration_ms", "at_ts"))


def calls_per_day(spark: SparkSession, folder: str) -> DataFrame:
    return report.calls_per_day(_activity(spark, folder, "at_ts", "tool", "ok"))


def read_write_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return report.read_write_ratio(_activity(spark, folder, "agent", "tool"))


def error_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _activity(spark, folder, "tool", "error").where("error is not null").groupBy("tool", "error").agg(F.count(F.lit(1)).alias("calls"))


def activity_keys(spark: SparkSession, folder: str) -> DataFrame:
    """What calls sum up to: each summary key's uses and total."""
    rows = _activity(spark, folder, "tool", "summary").select("tool", F.explode("summary").alias("key", "value"))
    return rows.groupBy("tool", "key").agg(F.count(F.lit(1)).alias("uses"), F.sum(F.col("value").try_cast("long")).alias("total"))


def qualifier_split(spark: SparkSession, folder: str) -> DataFrame:
    identifying, descriptive = text.split_qualifiers(F.col("summary"))
    return _activity(spark, folder, "summary").select("id", ingest.entries(identifying).alias("identifying"), ingest.entries(descriptive).alias("descriptive")).where("summary is not null")


def descriptive_claims(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.descriptive_claims(_activity(spark, folder, "summary"), "id", "summary")


def fingerprint_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    found = ingest.propositions(projection.catalogue_claims(spark, folder))
    return found.select("fingerprint", "assertions", F.date_format("first_said", "yyyy-MM-dd HH:mm:ss").alias("first_said"))


def replayed_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that were delivered more than once, which an idempotent reader takes once."""
    return table(spark, folder, "mention").groupBy("mention_id").agg(F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")


def predicate_families(spark: SparkSession, folder: str) -> DataFrame:
    return report.predicate_families(projection.supply_claims(spark, folder).unionByName(projection.catalogue_claims(spark, folder)))


def assertion_quality(spark: SparkSession, folder: str) -> DataFrame:
    return report.assertion_quality(projection.event_claims(spark, folder))


def kind_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyed(spark, folder, "entity", "id", "canonical_id", "kind", "provisional").where("canonical_id = id")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.count_if("provisional").alias("provisional"))


def listing_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical entities of each kind in order of name, the first 200 of each."""
    from pyspark.sql import Window as W

    rows = keyed(spark, folder, "entity", "id", "canonical_id", "kind", "display_name").where("canonical_id = id")
    place = F.row_number().over(W.partitionBy("kind").orderBy("display_name", "id"))
    return rows.withColumn("place", place).where("place <= 200").select("kind", "place", "id")


def redacted_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyed(spark, folder, "entity", "id", "kind", "display_name")
    return rows.select("id", text.pseudonym(F.col("display_name"), F.col("kind"), report.SALT).alias("name"))


def redacted_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyed(spark, folder, "evidence", "evidence_id", "path")
    return rows.groupBy(text.path_shape(F.col("path")).alias("shape")).agg(F.count(F.lit(1)).alias("files"))


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = similar.top_similar(vectors, vectors.where("id % 20 = 0"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank", similar.strength(F.round("score", 9)).alias("strength"))


def text_similar(spark: SparkSession, folder: str) -> DataFrame:
    """The five documents most alike in words to every document whose id is divisible by 20."""
    vectors = settle(similar.bags(table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")))
    return similar.top_similar(vectors, vectors.where("id % 20 = 0")).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def entity_profiles(spark: SparkSession, folder: str) -> DataFrame:
    entities = keyed(spark, folder, "entity", "id", "display_name", "kind")
    return similar.profiles(entities, _edges(spark, folder)).select("id", "profile_hash")


def stale_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Entities whose profile changed with the links of the last days, so only they are embedded again."""
    from attesta.operators import temporal

    entities = keyed(spark, folder, "entity", "id", "display_name", "kind")
    roots = graph.canonical_map(keyed(spark, folder, "entity", "id", "canonical_id"))
    claims = projection.catalogue_claims(spark, folder)
    then = similar.profiles(entities, graph.canonical_edges(temporal.edges_at(claims, "2023-01-08 00:00:00"), roots))
    now = similar.profiles(entities, graph.canonical_edges(temporal.edges_at(claims, CATALOGUE_AT), roots))
    return now.join(then.select("id", F.col("profile_hash").alias("indexed")), "id").where("profile_hash <> indexed").select("id", "profile_hash")


def stream_calls_per_day(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each day and tool; a call that is delivered twice counts once."""
    return streams.drain(spark, folder, "activity", "at_ts", streams.daily_calls)


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Each session's stretches, by the rule of ``p2_sessions``."""
    return streams.drain(spark, folder, "activity", "at_ts", streams.session_windows)


def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by kind, each delivery taken once on its way in."""
    rows = streams.drain(spark, folder, "mention", "seen_at", lambda df: streams.once(df.select("mention_id", "kind", "seen_at"), "mention_id", "seen_at"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("mentions"))


def stream_last_values(spark: SparkSession, folder: str) -> DataFrame:
    orders = streams.stream(spark, folder, "orders").withColumn("moment", F.struct("o_orderdate", "o_orderkey"))
    return streams.drain_latest(streams.last_values(orders, ["o_custkey"], "o_orderpriority", "moment"), ["o_custkey"], "since").select("o_custkey", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            usage_by_tool, calls_per_day, read_write_ratio, error_counts, activity_keys, qualifier_split, descriptive_claims, fingerprint_dedupe, replayed_deliveries, predicate_families, assertion_quality,
            kind_histogram, listing_by_kind, redacted_names, redacted_paths, cosine_topk, text_similar, entity_profiles, stale_embeddings, stream_calls_per_day, stream_sessions, stream_once, stream_last_values,
        )
    }


CALLS = "calls as (select distinct on (id) * from activity)"


def _profiles(name: str, canon: str) -> str:
    return f"""{name} as (
  select e.id, sha256(concat_ws('. ', display_name || ', ' || kind, r.relations)) as profile_hash from (select distinct on (id) * from entity) e left join (
    select id, string_agg(phrase, '. ' order by phrase) as relations from (
      select distinct id, phrase, dense_rank() over (partition by id order by phrase) as nth from (
        select c.subject as id, replace(predicate, '_', ' ') || ' ' || o.display_name as phrase from {canon} c join entity o on o.id = c.object
        union select c.object, 'is what ' || replace(predicate, '_', ' ') || ' for ' || s.display_name from {canon} c join entity s on s.id = c.subject)) where nth <= 12 group by id) r on r.id = e.id)"""


def oracle_sql() -> dict[str, str]:
    identifying = ", ".join(f"'{k}'" for k in IDENTIFYING)
    entries = "list_transform(list_filter(map_entries(summary), lambda e: e.value is not null and e.value <> ''), lambda e: {'k': lower(trim(e.key)), 'v': trim(e.value)})"

    def said(which: str) -> str:
        return f"array_to_string(list_transform(list_sort(list_filter({entries}, lambda e: {which} e.k in ({identifying}))), lambda e: e.k || '=' || e.v), ',')"

    fingerprint = "sha256('e|' || subject || chr(10) || predicate || chr(10) || case when object is not null then 'e|' || object else 'l|' || object_literal end || chr(10))"
    families = ", ".join(f"('{n}', '{f}')" for n, f, _ in predicate_rows())
    shape = "case when path is null or path = '' then '(none)' else '[path depth=' || len(list_filter(string_split(path, '/'), lambda p: p <> '')) || ' ' || case when contains(path, '.') then '.' || string_split(path, '.')[-1] else '(no ext)' end || ']' end"
    per_day = "strftime(at_ts at time zone 'UTC', '%Y-%m-%d') as day, tool, count(*) as calls, count(*) filter (where not ok) as failures"
    edges = sql.edges(sql.CATALOGUE_CLAIMS, CATALOGUE_AT)
    then = sql.live("timestamp '2023-01-08 00:00:00'").replace("live as", "live_then as", 1) + "," + sql.EDGES.replace("grouped", "grouped_then").replace("edges as", "edges_then as").replace("from live ", "from live_then ")
    canon_then = "canon_then as (select proposition_id, coalesce(s.root, subject) as subject, predicate, coalesce(o.root, object) as object from edges_then left join roots s on s.id = subject left join roots o on o.id = object)"
    return {
        "usage_by_tool": f"""with {CALLS} select source, tool, count(*) as calls, count(*) filter (where not ok) as failures, round(avg(duration_ms), 3) as mean_ms, max(duration_ms) as max_ms,
  strftime(min(at_ts) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as first_call, strftime(max(at_ts) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as last_call from calls group by source, tool""",
        "calls_per_day": f"with {CALLS} select {per_day} from calls group by 1, 2",
        "read_write_ratio": f"""with {CALLS}, n as (select agent, count(*) filter (where tool in {report.READING}) as reads, count(*) filter (where tool in {report.WRITING}) as writes from calls group by agent)
select agent, reads, writes, round(case when writes > 0 then reads / writes end, 3) as ratio from n""",
        "error_counts": f"with {CALLS} select tool, error, count(*) as calls from calls where error is not null group by all",
        "activity_keys": f"with {CALLS}, kv as (select tool, unnest(map_entries(summary)) as e from calls) select tool, e.key as key, count(*) as uses, sum(try_cast(e.value as bigint))::bigint as total from kv group by all",
        "qualifier_split": f"with {CALLS} select id, {said('')} as identifying, {said('not')} as descriptive from calls where summary is not null",
        "descriptive_claims": f"with {CALLS}, kv as (select id as about, unnest({entries}) as e from calls) select about, e.k as predicate, e.v as value from kv where e.k not in ({identifying})",
        "fingerprint_dedupe": f"with {sql.CATALOGUE_CLAIMS} select {fingerprint} as fingerprint, count(*) as assertions, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as first_said from claims group by 1",
        "replayed_deliveries": "select mention_id, count(*) as deliveries from mention group by 1 having count(*) > 1",
        "predicate_families": f"""with families(predicate, family) as (values {families}), {sql.SUPPLY_CLAIMS.replace('claims as', 'supply as')}, {sql.CATALOGUE_CLAIMS},
both_claims as (select predicate, proposition_id from supply union all select predicate, proposition_id from claims)
select coalesce(family, 'other') as family, predicate, count(distinct proposition_id) as propositions, count(*) as assertions from both_claims left join families using (predicate) group by all""",
        "assertion_quality": f"""with {sql.EVENT_CLAIMS}, m as (select proposition_id, count(distinct method) as methods from claims group by 1)
select method, count(*) as assertions, count(*) filter (where not polarity) as refutations, count(distinct proposition_id) as propositions, count(distinct case when methods = 1 then proposition_id end) as uncorroborated,
  round(avg(confidence), 6) as mean_confidence from claims join m using (proposition_id) group by method""",
        "kind_histogram": "select kind, count(*) as entities, count(*) filter (where provisional) as provisional from entity where canonical_id = id group by kind",
        "listing_by_kind": "select kind, row_number() over (partition by kind order by display_name, id) as place, id from entity where canonical_id = id qualify place <= 200",
        "redacted_names": f"select id, case when display_name is null then '(none)' else kind || '-' || left(sha256('{report.SALT}' || lower(trim(display_name))), 4) end as name from entity",
        "redacted_paths": f"select {shape} as shape, count(*) as files from (select distinct on (evidence_id) * from evidence) group by 1",
        "cosine_topk": """with v as (select vec_id as id, embedding::double[] as e from embeddings),
scores as (select q.id as query_id, v.id, list_cosine_similarity(q.e, v.e) as score from v q join v on v.id <> q.id where q.id % 20 = 0)
select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by round(scores.score, 9) desc, id) as rank, case when round(scores.score, 9) >= 0.5 then 'strong' when round(scores.score, 9) >= 0.35 then 'moderate' else 'weak' end as strength
from scores qualify rank <= 5""",
        "text_similar": """with words as (select doc_id as id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+')) as word from documents where text is not null),
n as (select id, ('0x' || left(md5(word), 4))::int % 256 as dim, count(*) as n from words where word <> '' group by all),
size as (select id, sqrt(sum(n * n)) as size from n group by id),
dots as (select q.id as query_id, v.id, sum(q.n * v.n) as dot from n q join n v on v.dim = q.dim and v.id <> q.id where q.id % 20 = 0 group by all),
pairs as (select q.id as query_id, v.id from size q join size v on q.id <> v.id where q.id % 20 = 0),
scores as (select p.query_id, p.id, coalesce(dot, 0) / (a.size * b.size) as score from pairs p left join dots d using (query_id, id) join size a on a.id = p.query_id join size b on b.id = p.id)
select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by round(scores.score, 9) desc, id) as rank from scores qualify rank <= 5""",
        "entity_profiles": edges + f", {CANON}, {_profiles('profiles', 'canon')} select id, profile_hash from profiles",
        "stale_embeddings": edges + f", {CANON}, {then}, {canon_then}, {_profiles('profiles', 'canon')}, {_profiles('earlier', 'canon_then')} select p.id, p.profile_hash from profiles p join earlier e using (id) where p.profile_hash <> e.profile_hash",
        "stream_calls_per_day": f"with {CALLS} select {per_day} from calls group by 1, 2",
        "stream_sessions": STRETCHES + "select session, make_timestamptz(min(s)) as started_at, make_timestamptz(max(e)) as ended_at, count(*) as calls from numbered group by session, nth",
        "stream_once": "select kind, count(distinct mention_id) as mentions from mention group by kind",
        "stream_last_values": "select o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as value from orders group by 1",
    }
