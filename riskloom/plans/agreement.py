"""Consolidation of several sources by priority, and how far the sources agree."""

from __future__ import annotations

from riskloom.plans.scoring import points


def sources(D) -> str:
    """CTE obs: points by source. regex: every value but a seventh; llm: shifted for some; manual: a tenth, as points."""
    return f"""{points(D)},
srcs as (select * from (values ('regex'), ('llm'), ('manual')) as s(source)),
obs as (select source, doc_id, period, factor, ord, case source when 'regex' then case when (doc_id + ord) % 7 = 0 then null else band end
    when 'llm' then case when (doc_id + ord) % 9 = 0 then null when (doc_id + 3 * ord) % 5 = 0 then (band + 1) % 4 else band end else (band + case when doc_id % 40 = 0 then 1 else 0 end) % 4 end points
  from (select *, case when origin = 'band' then points end band from pts) p cross join srcs where source = 'regex' or (origin = 'band' and ((source = 'llm' and doc_id % 17 <> 0) or (source = 'manual' and doc_id % 10 = 0)))),
prefs as (select factor, case when ord % 2 = 0 then 'regex' else 'llm' end preferred from factors)"""


def cells(D) -> str:
    """CTE cells: gold (manual) cells against the automated sources, with a category each."""
    return f"""{sources(D)},
gold as (select doc_id, period, factor, case when doc_id % 30 = 0 and ord = 3 then null else points end gold from obs where source = 'manual'),
cells as (select s.source, g.doc_id, g.factor, case when g.period = 'EUROPE' then 'new' else 'other' end subset, g.gold, o.points,
    case when g.gold is null then 'not_comparable' when o.points is null then 'not_found' when o.points = g.gold then 'agree' else 'disagree' end category
  from gold g cross join (select 'regex' source union all select 'llm') s left join obs o on o.source = s.source and o.doc_id = g.doc_id and o.factor = g.factor)"""


def tallies(D) -> str:
    """CTE tallies: counts for every source, factor or all, subset or all; empty cells exist."""
    return f"""{cells(D)},
space as (select source, factor, subset from (select distinct source from cells) a cross join (select factor from factors union all select 'all') b cross join (select 'new' subset union all select 'other' union all select 'all') c),
counted as (select source, coalesce(factor, 'all') factor, coalesce(subset, 'all') subset, count(case when category = 'agree' then 1 end) agree, count(case when category = 'disagree' then 1 end) disagree, count(case when category = 'not_found' then 1 end) not_found, count(case when category = 'not_comparable' then 1 end) not_comparable,
    cast(sum(case when category in ('agree', 'disagree') then abs(gold - points) else 0 end) as bigint) diff from cells group by source, grouping sets ((source, factor, subset), (source, factor), (source, subset), (source))),
tallies as (select s.source, s.factor, s.subset, coalesce(agree, 0) agree, coalesce(disagree, 0) disagree, coalesce(not_found, 0) not_found, coalesce(not_comparable, 0) not_comparable, coalesce(diff, 0) diff from space s left join counted c on s.source = c.source and s.factor = c.factor and s.subset = c.subset)""".replace("group by source, grouping sets", "group by grouping sets")


def wilson(k: str, n: str) -> str:
    """Two columns, the bounds of the 95 % Wilson interval of k out of n; null where n is 0."""
    z = 1.959963984540054
    k, n = f"cast({k} as double)", f"cast({n} as double)"
    zz = f"cast({z * z!r} as double)"
    mid, half = f"({k} + {zz} / 2) / ({n} + {zz})", f"cast({z!r} as double) * sqrt({k} * ({n} - {k}) / {n} + {zz} / 4) / ({n} + {zz})"
    return f"case when {n} > 0 then round(greatest(cast(0 as double), {mid} - {half}), 6) end low, case when {n} > 0 then round(least(cast(1 as double), {mid} + {half}), 6) end high"


def consolidated(D) -> str:
    return f"""{sources(D)},
wide as (select doc_id, factor, ord, max(case when source = 'manual' then points end) m, max(case when source = 'regex' then points end) r, max(case when source = 'llm' then points end) l from obs group by doc_id, factor, ord),
cons as (select k.doc_id, k.factor, preferred, case when m is not null then 'manual' when preferred = 'regex' and r is not null or preferred = 'llm' and l is not null then 'preferred' when r is not null or l is not null then 'fallback' else 'none' end rule,
    coalesce(m, case preferred when 'regex' then r else l end, r, l) points, r, l from (select doc_id, f.factor from docs cross join factors f) k join prefs p on k.factor = p.factor left join wide w on k.doc_id = w.doc_id and k.factor = w.factor)"""


def confusion(D) -> str:
    return f"{cells(D)}, levels as (select * from (values (0), (1), (2), (3)) as x(v)), pairs as (select source, gold, points, count(*) n from cells where category in ('agree', 'disagree') group by source, gold, points)"


SQL = {
    "consolidate_priority": lambda D: f"with {consolidated(D)} select doc_id, factor, rule, points from cons",
    "consolidate_rule_counts": lambda D: f"with {consolidated(D)} select factor, preferred, rule, count(*) n from cons group by factor, preferred, rule",
    "source_disagreement": lambda D: f"with {consolidated(D)} select factor, count(case when r is not null and l is not null then 1 end) both_found, count(case when r <> l then 1 end) differ from cons group by factor",
    "missing_documents": lambda D: f"with {sources(D)} select d.doc_id, d.programme from docs d left anti join (select distinct doc_id from obs where source = 'llm' and points is not null) o on d.doc_id = o.doc_id" if D.idiv == "div" else f"with {sources(D)} select d.doc_id, d.programme from docs d anti join (select distinct doc_id from obs where source = 'llm' and points is not null) o on d.doc_id = o.doc_id",
    "preferences_cover": lambda D: f"with {sources(D)} select f.factor, p.preferred, case when p.factor is null then 1 else 0 end uncovered from factors f full outer join prefs p on f.factor = p.factor",
    "key_difference": lambda D: f"with {sources(D)}, a as (select distinct doc_id from obs where source = 'regex' and points is not null and factor = 'konzorcium'), b as (select distinct doc_id from obs where source = 'llm' and points is not null and factor = 'konzorcium') select coalesce(a.doc_id, b.doc_id) doc_id, case when a.doc_id is null then 'llm' else 'regex' end only_in from a full outer join b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null",
    "agreement_grouping_sets": lambda D: f"with {tallies(D)} select *, case when agree + disagree > 0 then round(cast(agree as double) / (agree + disagree), 6) end agreement, case when agree + disagree + not_found > 0 then round(cast(agree + disagree as double) / (agree + disagree + not_found), 6) end found, case when agree + disagree > 0 then round(cast(diff as double) / (agree + disagree), 6) end mean_abs_diff from tallies",
    "agreement_confusion": lambda D: f"with {confusion(D)} select s.source, g.v gold, p.v got, coalesce(n, 0) n from (select distinct source from cells) s cross join levels g cross join levels p left join pairs c on c.source = s.source and c.gold = g.v and c.points = p.v",
    "wilson_intervals": lambda D: f"with {tallies(D)} select source, factor, subset, agree, agree + disagree n, {wilson('agree', '(agree + disagree)')} from tallies",
    "preference_suggestion": lambda D: f"with {tallies(D)} select factor, max(case when source = 'regex' then agree end) regex_agree, max(case when source = 'llm' then agree end) llm_agree, case when max(case when source = 'llm' then agree end) > max(case when source = 'regex' then agree end) then 'llm' else 'regex' end suggested from tallies where subset = 'all' and factor <> 'all' group by factor",
    "label_agreement_kappa": lambda D: f"""with {confusion(D)}, p3 as (select source, least(gold, 2) a, least(points, 2) b, cast(sum(n) as bigint) n from pairs group by source, least(gold, 2), least(points, 2)),
t as (select source, cast(sum(n) as bigint) n, cast(sum(n * (a - b) * (a - b)) as bigint) o from p3 group by source), ra as (select source, a, cast(sum(n) as bigint) m from p3 group by source, a), cb as (select source, b, cast(sum(n) as bigint) m from p3 group by source, b),
e as (select ra.source, cast(sum((a - b) * (a - b) * ra.m * cb.m) as bigint) e from ra join cb on ra.source = cb.source group by ra.source)
select t.source, n, n * o observed, e expected, case when e <> 0 then round(1 - cast(n * o as double) / e, 9) end kappa from t join e on t.source = e.source""",
    "label_error_sizes": lambda D: f"with {confusion(D)}, e as (select source, points - gold size, cast(sum(n) as bigint) n from pairs group by source, points - gold) select s.source, x.size, coalesce(n, 0) n from (select distinct source from cells) s cross join (select * from (values (-3), (-2), (-1), (0), (1), (2), (3)) as x(size)) x left join e on e.source = s.source and e.size = x.size",
    "acceptance_counts": lambda D: f"with {cells(D)}, a as (select factor, count(case when source = 'regex' and category = 'agree' then 1 end) old_agree, count(case when source = 'llm' and category = 'agree' then 1 end) new_agree, count(case when source = 'llm' and category in ('agree', 'disagree') then 1 end) new_found from cells group by factor) select *, case when new_agree >= old_agree then 1 else 0 end accepted from a",
    "all_error_documents": lambda D: "select user_id, cast(ts as date) day_, count(*) n from events group by user_id, cast(ts as date) having sum(case when event_type <> 'error' then 1 else 0 end) = 0",
    "status_pivot": lambda D: "select user_id, count(case when event_type = 'error' then 1 end) error, count(case when event_type = 'click' then 1 end) click, count(case when event_type = 'purchase' then 1 end) purchase, count(case when event_type in ('view', 'signup') then 1 end) other from events group by user_id",
    "json_properties": lambda D: f"select event_type, cast({D.json('props', 'k')} as bigint) % 10 k, count(*) n from events group by event_type, cast({D.json('props', 'k')} as bigint) % 10",
    "distinct_counts": lambda D: "select event_type, count(distinct user_id) users, count(*) n, max(ts) last_ts from events group by event_type",
    "run_state_latest": lambda D: f"select user_id, max_by(event_type, {D.st}(ts, event_id)) state, count(*) changes from events group by user_id",
    "prefix_filters": lambda D: "select p_type, p_brand, count(*) n from part where (p_name like 'p%' or p_name like 'a%' or p_type like 'S%') and p_brand is not null group by p_type, p_brand",
    "ordered_mixed": lambda D: "select c_custkey, c_mktsegment, cast(row_number() over (partition by c_mktsegment order by case when c_nationkey <> 3 then 1 else 0 end, c_acctbal desc, c_custkey) as bigint) place from customer",
    "lineage_walk": lambda D: "with edges as (select o_orderkey run, o_orderkey - o_orderkey % 8 parent from orders), hop as (select a.run, b.parent from edges a join edges b on a.parent = b.run), far as (select h.run, e.parent from hop h join edges e on h.parent = e.run) select parent root, count(*) n, count(distinct run) runs from far group by parent",
    "division_newest": lambda D: "with wanted as (select distinct event_type from events), have as (select user_id, count(distinct event_type) n, max(ts) last from events group by user_id) select user_id, n from have where n = (select count(*) from wanted)",
    "upsert_keep_latest": lambda D: "with new as (select user_id, event_id, value from events where event_type = 'purchase'), old as (select user_id, event_id, value from events where event_id % 3 = 0) select event_id, user_id, value, 'new' origin from new union all select o.event_id, o.user_id, o.value, 'old' origin from old o where not exists (select 1 from new n where n.event_id = o.event_id)",
    "grouping_fates": lambda D: "select c_mktsegment programme, n_name period, count(*) n from customer join nation on c_nationkey = n_nationkey group by grouping sets ((c_mktsegment), (n_name), (c_mktsegment, n_name), ())",
    "cost_sums": lambda D: "select role, count(*) requests, cast(sum(length(text)) as bigint) characters, round(sum(length(text)) * 1.0 / 1000000 * case when role = 'assistant' then 5 else 1 end, 6) cost from conversations group by role".replace("round(sum(length(text)) * 1.0 / 1000000 *", "round(cast(sum(length(text)) as double) / 1000000 *"),
    "last_answers": lambda D: f"select conv_id, max_by(text, turn) answer, max(turn) attempt, count(distinct turn) parts, case when count(distinct turn) = max(turn) - min(turn) + 1 then 1 else 0 end complete from conversations where role <> 'system' group by conv_id",
}
