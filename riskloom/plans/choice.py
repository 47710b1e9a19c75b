"""Versions chosen among a client's changes, and typed records of clicks held against their domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators.domains import Domain, violations
from riskloom.operators.versions import chosen
from riskloom.sources.tables import table

#: A file name for each change: dates for a third of the clients, numbers for a third, both for the rest.
_DATED = "concat(coalesce(source, 'x'), '-felhivas-', {day}, '.pdf')"
_NUMBERED = "concat(coalesce(source, 'x'), '_felhívás', case when seq = 0 then '' when seq = 1 then '_módosítás' when op = 'U' then concat('-v', seq) else concat('_', seq, '-sz-mod') end, '.PDF')"
_NAME = f"case when client_id % 3 = 0 or client_id % 3 = 1 and op = 'I' then {_DATED} else {_NUMBERED} end"
_PINS, _OVERRIDES = "client_id % 29 = 5 and op <> 'D'", "client_id % 31 = 7 and op <> 'D'"


def version_choice(spark, sf_dir):
    """Fate of every change of every client, one version a client; deletions can't be read."""
    rows = table(spark, sf_dir, "client_changes").select("change_id", "client_id", "seq", "op", "valid_at", "source").distinct()
    candidates = rows.selectExpr("client_id call", "change_id id", f"{_NAME.format(day='date_format(valid_at, ' + repr('yyyyMMdd') + ')')} name", "op <> 'D' readable")
    one = lambda cond: rows.where(cond).groupBy("client_id").agg(F.min("change_id").alias("id")).withColumnRenamed("client_id", "call")
    return chosen(candidates, one(_PINS), one(_OVERRIDES)).select(F.col("call").alias("client_id"), F.col("id").alias("change_id"), "fate", "reason", "chosen_by")


#: What a click's record may hold.
PROPS = {
    "k": Domain(numbers=True, least=0, most=90, whole=True),
    "device.os": Domain(words=("android", "ios", "web")),
    "tags": Domain(members=("a", "b"), needed=False),
}


def typed_domain_violations(spark, sf_dir):
    """Violations of every click's record by field and kind."""
    return violations(table(spark, sf_dir, "clicks"), "click_id", "props", PROPS)


QUERIES = {"version_choice": version_choice, "typed_domain_violations": typed_domain_violations}

# DuckDB, another way: ranks of each call in order, ties carried down by windows; JSON types.
_RANK = r"""case when d <> '' then d::hugeint when regexp_matches(f, '[0-9]+-sz-mod') then regexp_extract(f, '([0-9]+)-sz-mod', 1)::hugeint when regexp_matches(f, '-v[0-9]+') then regexp_extract(f, '-v([0-9]+)', 1)::hugeint when f like '%modositas%' then 1 else 0 end"""
ORACLE = {
    "version_choice": f"""with c as (select distinct change_id, client_id, seq, op, valid_at, source from client_changes),
n as (select *, lower(strip_accents({_NAME.format(day="strftime(valid_at, '%Y%m%d')")})) f, op <> 'D' ok from c), d as (select *, regexp_extract(f, '-(20[0-9]{{6}})', 1) d from n),
r as (select *, d <> '' dated, {_RANK} v from d),
p as (select client_id, min(change_id) pin from c where {_PINS} group by 1), o as (select client_id, min(change_id) ov from c where {_OVERRIDES} group by 1),
w as (select r.*, pin, ov, count(*) over (partition by r.client_id) n, count(*) over (partition by r.client_id, v) ties, bool_or(dated) over (partition by r.client_id) and not bool_and(dated) over (partition by r.client_id) mixed from r left join p on r.client_id = p.client_id left join o on r.client_id = o.client_id),
x as (select *, max(ties > 1) over (partition by client_id order by v desc) bad, count(*) over (partition by client_id order by v desc) upto from w),
y as (select *, max(case when ok and not bad then v end) over (partition by client_id) pick from x),
z as (select *, case when client_id is null then 'needs_review,call_unknown' when pin is not null then case when change_id = pin then 'included,' else 'excluded,not_the_gold_version' end
 when ov is not null then case when change_id = ov then 'included,' else 'excluded,older_version' end
 when n > 1 and mixed then 'needs_review,version_unclear' when pick is not null then case when v > pick then 'excluded,unreadable' when v = pick then 'included,' else 'excluded,older_version' end
 when bad then 'needs_review,version_unclear' else 'excluded,unreadable' end t from y)
select client_id, change_id, split_part(t, ',', 1) fate, nullif(split_part(t, ',', 2), '') reason, case when t <> 'included,' then null when pin is not null then 'gold_pin' when ov is not null then 'override' when upto = n then 'only' else 'version' end chosen_by from z""",
    "typed_domain_violations": """with j as (select click_id, props, json_valid(props) ok from clicks), r as (select click_id, case when ok then props::json end p from j where ok),
x as (select click_id, unnest([
 {'field': 'k', 'violation': case when json_type(p, '$.k') is null then 'missing' when json_type(p, '$.k') = 'NULL' then 'null' when json_type(p, '$.k') not in ('BIGINT', 'UBIGINT', 'DOUBLE') then 'wrong type' when (p->>'$.k')::double <> floor((p->>'$.k')::double) then 'not whole' when (p->>'$.k')::double < 0 then 'too small' when (p->>'$.k')::double > 90 then 'too large' end},
 {'field': 'device.os', 'violation': case when json_type(p, '$.device.os') is null then 'missing' when json_type(p, '$.device.os') = 'NULL' then 'null' when json_type(p, '$.device.os') <> 'VARCHAR' then 'wrong type' when (p->>'$.device.os') not in ('android', 'ios', 'web') then 'unknown word' end},
 {'field': 'tags', 'violation': case when json_type(p, '$.tags') is null then null when json_type(p, '$.tags') = 'NULL' then 'null' when json_type(p, '$.tags') <> 'ARRAY' then 'wrong type' when json_array_length(p, '$.tags') = 0 then 'empty list' when len(list_filter(from_json(p->'$.tags', '["JSON"]'), lambda m: coalesce(json_type(m) <> 'VARCHAR' or (m->>'$') not in ('a', 'b'), true))) > 0 then 'unknown member' end}]) s from r where json_type(p) = 'OBJECT'),
u as (select click_id, unnest(json_keys(p)) field from r where json_type(p) = 'OBJECT')
select click_id, s.field field, s.violation violation from x where s.violation is not null
union all select click_id, field, 'unknown field' from u where field not in ('k', 'device', 'tags')
union all select click_id, null, case when props is null then 'no record' when not ok then 'broken record' else 'not an object' end from j where props is null or not ok or json_type(props) <> 'OBJECT'
union all select click_id, null, 'several records' from clicks group by click_id having count(*) > 1""",
}
