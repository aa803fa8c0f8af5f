"""SQL fragments that the checking queries share: the projections and the trust of claims."""

from __future__ import annotations

EVENT_CLAIMS = r"""
claims as (
  select 'user:' || user_id as subject, 'calls' as predicate, 'ep:' || (k % 10) as object, cast(null as varchar) as object_literal, event_type <> 'error' as polarity,
    case event_type when 'click' then 'code_derived' when 'view' then 'llm_inferred' when 'purchase' then 'human' when 'signup' then 'telemetry' else 'verifier' end as method,
    least(value / 500, 1.0) as confidence, ts as created_at, 'run:' || strftime(ts, '%Y-%m-%d') as scope_key, 'user:' || user_id || '|calls|ep:' || (k % 10) as proposition_id
  from (select *, cast(regexp_extract(props, '(\d+)', 1) as int) as k from events))"""

OWNERSHIP_CLAIMS = """
claims as (
  select 'cust:' || o_custkey as subject, 'owned_by' as predicate, cast(null as varchar) as object, o_orderpriority as object_literal, true as polarity, 'human' as method,
    cast(null as double) as confidence, o_orderdate as created_at, cast(null as varchar) as scope_key, 'cust:' || o_custkey || '|owned_by|' || o_orderpriority as proposition_id
  from orders)"""

SUPPLY_CLAIMS = """
links as (
  select 'cust:' || o_custkey as subject, 'calls' as predicate, 'supp:' || l_suppkey as object, min(l_shipdate) as created_at from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_suppkey
  union all select 'supp:' || l_suppkey, 'reads_from', 'part:' || l_partkey, min(l_shipdate) from lineitem group by l_suppkey, l_partkey
  union all select 'part:' || p_partkey, 'part_of', 'brand:' || p_brand, timestamp '1992-01-01' from part
  union all select 'supp:' || s_suppkey, 'lives_in_repo', 'nation:' || s_nationkey, timestamp '1992-01-01' from supplier
  union all select 'cust:' || c_custkey, 'lives_in_repo', 'nation:' || c_nationkey, timestamp '1992-01-01' from customer
  union all select 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey, timestamp '1992-01-01' from nation),
claims as (
  select subject, predicate, object, cast(null as varchar) as object_literal, true as polarity, 'code_derived' as method, cast(null as double) as confidence, created_at,
    cast(null as varchar) as scope_key, subject || '|' || predicate || '|' || object as proposition_id
  from links)"""


def entity_id(column: str) -> str:
    digits = f"lower(regexp_replace({column}, '[^0-9A-Fa-f]', '', 'g'))"
    parts = " || '-' || ".join(f"substr({digits}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"case when length({digits}) = 32 then {parts} end"


CATALOGUE_CLAIMS = f"""
pairs as (
  select distinct on (id) id, {entity_id('from_id')} as subject, {entity_id('into_id')} as object, score, method, created_at::timestamp as created_at, lower(trim(resolution, ' ' || chr(9) || chr(10) || chr(13))) as verdict
  from merge_candidate),
linked as (
  select p.*, e.kind, case when e.kind = 'endpoint' and p.id % 2 = 1 then 'calls' when e.kind = 'endpoint' then 'exposes_endpoint' when e.kind = 'repo' then 'lives_in_repo' when e.kind = 'team' then 'owned_by'
      when e.kind = 'iac_module' then 'provisioned_by' when e.kind in ('datastore', 'cache', 'queue') then 'reads_from' when e.kind = 'package' then 'depends_on_package' else 'depends_on' end as predicate
  from pairs p join entity e on e.id = p.object where p.subject is not null and p.object is not null and p.subject <> p.object),
claims as (
  select subject, predicate, object, cast(null as varchar) as object_literal, coalesce(verdict <> 'distinct', true) as polarity,
    case method when 'human' then 'human' when 'trigram' then 'telemetry' when 'dice' then 'llm_inferred' else 'other' end as method,
    score as confidence, created_at, 'day:' || strftime(created_at, '%Y-%m-%d') as scope_key, subject || '|' || predicate || '|' || object as proposition_id
  from linked)"""

BASE = "case method when 'human' then 0.95 when 'telemetry' then 0.9 when 'code_derived' then 0.85 when 'verifier' then 0.8 when 'llm_inferred' then 0.4 else 0.3 end::double"
HALF_LIFE = "case method when 'telemetry' then 14 when 'llm_inferred' then 30 when 'verifier' then 60 when 'code_derived' then 90 when 'human' then 180 else 30 end"


def weight(at: str) -> str:
    age = f"greatest((epoch_us({at}) - epoch_us(created_at)) / 1e6, 0.0)"
    return f"{BASE} * exp(-ln(2.0::double) * {age} / (86400.0::double * {HALF_LIFE})) * coalesce(confidence, 1.0)"


def live(at: str, source: str = "claims") -> str:
    return f"live as (select *, {weight(at)} as weight from {source} where created_at <= {at})"


TRUST = "greatest(0.0, support * least(1.0 + 0.1 * greatest(methods - 1, 0), 1.2) - coalesce(refute, 0.0))"

EDGES = f"""
grouped as (
  select proposition_id, any_value(subject) as subject, any_value(predicate) as predicate, any_value(object) as object, any_value(object_literal) as object_literal,
    max(weight) filter (where polarity) as support, max(weight) filter (where not polarity) as refute,
    count(*) filter (where polarity) as support_count, count(*) filter (where not polarity) as refute_count, count(distinct method) filter (where polarity) as methods
  from live group by proposition_id),
edges as (
  select proposition_id, subject, predicate, object, object_literal, {TRUST} as trust, support_count, refute_count, methods from grouped where support is not null)"""


def edges(claims: str, at: str) -> str:
    return f"with recursive {claims},\n{live(f"timestamp '{at}'")},{EDGES}"
