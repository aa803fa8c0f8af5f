"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import credentials, duplicates, encoding, groups, leakage, names, packing
from attesta.sources.tables import keyed, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    evidence = keyed(spark, folder, "evidence", "evidence_id", "span_text")
    entity = keyed(spark, folder, "entity", "id", "kind", "env", "display_name")
    return duplicates.duplicate_records(evidence, entity).select("src", "rec_id", "first_id")


def p1_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One record per group of equal citations or entities, with its number of copies."""
    evidence = keyed(spark, folder, "evidence", "evidence_id", "span_text")
    entity = keyed(spark, folder, "entity", "id", "kind", "env", "display_name")
    found = duplicates.duplicate_records(evidence, entity)
    return found.where("rec_id = first_id").select("src", "first_id", "copies")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.entity_groups(table(spark, folder, "merge_candidate"), keyed(spark, folder, "entity", "id", "canonical_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = table(spark, folder, "evidence").select(F.col("evidence_id").alias("id"), F.col("span_text").alias("text"))
    found = credentials.credentials(spans)
    return found.select(F.col("id").alias("evidence_id"), F.explode("secrets.secret").alias("secret")).distinct()


def p4_places(spark: SparkSession, folder: str) -> DataFrame:
    """For each kind of place the values found there, and how many characters they have per subword."""
    spans = keyed(spark, folder, "evidence", "evidence_id", "span_text").select(F.col("evidence_id").alias("id"), F.col("span_text").alias("text"))
    found = credentials.credentials(spans).select("id", F.explode("secrets").alias("s")).select("id", "s.*")
    return found.groupBy("place").agg(F.count(F.lit(1)).alias("found"), F.round(F.min("per_subword"), 3).alias("least"), F.round(F.avg("per_subword"), 3).alias("mean"), F.round(F.max("per_subword"), 3).alias("most"))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every citation that holds a credential, with the credential overwritten in place."""
    spans = keyed(spark, folder, "evidence", "evidence_id", "span_text").select(F.col("evidence_id").alias("id"), F.col("span_text").alias("text"))
    return credentials.credentials(spans).select(F.col("id").alias("evidence_id"), "redacted", F.size("secrets").alias("secrets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    mention = keyed(spark, folder, "mention", "mention_id", "raw", "kind")
    entity = keyed(spark, folder, "entity", "id", "kind", "display_name")
    return names.attributed(mention, entity).select("mention_id", "entity_id").distinct()


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "source", "text"))


#: Proportions of a training mixture; sources that aren't named share the rest.
MIXTURE = {"git": 0.3, "wiki": 0.25, "tracker": 0.2, "chat": 0.15}


def p6_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, share and target of each source in each window of 256 containers, each source by its size."""
    return packing.mixture(table(spark, folder, "documents").select("doc_id", "source", "text"))


def p6_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The same with given proportions, in windows of 64 containers."""
    return packing.mixture(table(spark, folder, "documents").select("doc_id", "source", "text"), window_containers=64, targets=MIXTURE)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each window are, with the given proportions."""
    return packing.fill(packing.pack(table(spark, folder, "documents").select("doc_id", "source", "text"), targets=MIXTURE))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    items = keyed(spark, folder, "eval_item", "item_id", "text")
    return leakage.shared_runs(documents, items)


def p7_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Items of which a region of 100 characters stands in a document with at most 6 edits."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    items = keyed(spark, folder, "eval_item", "item_id", "text")
    return leakage.leaks(documents, items, length=100, budget=6, q=8).distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled document with its original text, null where that can't be had in full."""
    return encoding.garbled_documents(table(spark, folder, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_copies, p3_found, p4_found, p4_places, p4_redacted, p5_found, p6_packed, p6_mixture, p6_targets, p6_fill, p7_found, p7_regions, p8_found, p8_restored)}


FIELDS = r"""list_filter(regexp_split_to_array(replace(regexp_replace(span_text, '^[\s\x{A0}`]*[\[({]?|[\])}]?[\s\x{A0}`;,]*$', '', 'g'), chr(8203), ''), '[\n\r,;]+'),
    lambda f: length(regexp_replace(f, '[^\p{L}\p{Nd}]+', '', 'g')) > 0)"""
FIELD = r"""^[\s\x{A0}]*["'']?[\p{L}_][\p{L}\p{Nd}_.\- /]*["'']?[\s\x{A0}]*[:=][\s\x{A0}]*("[^"]*"|''[^'']*''|[^"''(){}\[\]<>=]*)[\s\x{A0}]*$"""

P1_GROUPS = rf"""
with spans as (select distinct on (evidence_id) evidence_id, span_text from evidence where span_text is not null),
fields as (select evidence_id, lower(regexp_replace(span_text, '[^\p{{L}}\p{{Nd}}]+', '', 'g')) as plain, {FIELDS} as f from spans),
keys as (
  select 'evidence' as src, cast(evidence_id as varchar) as rec_id, evidence_id as num,
    case when len(f) >= 3 and list_bool_and(list_transform(f, lambda x: regexp_matches(x, '{FIELD}')))
      then 'k' || array_to_string(list_sort(list_transform(f, lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{Nd}}]+', '', 'g')))), chr(10))
      else 'v' || plain end as canon
  from fields where plain <> ''
  union all
  select 'entity', id, null, 't' || coalesce('=' || kind, '') || chr(10) || coalesce('=' || env, '') || chr(10) || lower(regexp_replace(display_name, '[^\p{{L}}\p{{Nd}}]+', '', 'g'))
  from entity where lower(regexp_replace(display_name, '[^\p{{L}}\p{{Nd}}]+', '', 'g')) <> ''),
found as (
  select src, rec_id, case when src = 'evidence' then cast(min(num) over g as varchar) else min(rec_id) over g end as first_id, count(*) over g as copies
  from keys window g as (partition by src, canon))
"""

WORDS = r"lower(trim(regexp_replace(text, '[^\p{L}\p{Nd}]+', ' ', 'g'), ' '))"


def _runs(table: str, key: str) -> str:
    return f"""(select distinct {key}, array_to_string(w[i : i + 11], ' ') as run
      from (select {key}, w, unnest(range(1, len(w) - 10)) as i from (select {key}, string_split({WORDS}, ' ') as w from {table} where text is not null)))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_GROUPS + "select src, rec_id, first_id from found where copies > 1",
        "p1_copies": P1_GROUPS + "select src, first_id, copies from found where copies > 1 and rec_id = first_id",
        "p3_found": """
with recursive known as (select distinct replace(lower(id), '-', '') as k, id from entity),
links as (
  select lower(regexp_replace(from_id, '[^0-9A-Fa-f]', '', 'g')) as a, lower(regexp_replace(into_id, '[^0-9A-Fa-f]', '', 'g')) as b
  from merge_candidate where lower(trim(resolution, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) = 'merged'
  union select replace(lower(id), '-', ''), lower(regexp_replace(canonical_id, '[^0-9A-Fa-f]', '', 'g')) from entity),
edges as (
  select a, b from links where a <> b and a in (select k from known) and b in (select k from known)
  union select b, a from links where a <> b and a in (select k from known) and b in (select k from known)),
reach as (select a as v, a as u from edges union select r.v, e.b from reach r join edges e on r.u = e.a),
grouped as (select v, min(id) as group_id from reach join known on u = k group by v)
select id as entity_id, group_id from grouped join known on v = k""",
        "p7_found": f"select distinct doc_id, item_id from {_runs('documents', 'doc_id')} d join {_runs('eval_item', 'item_id')} i using (run)",
    }
