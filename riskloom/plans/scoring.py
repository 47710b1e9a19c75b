"""Factor values, points, exact totals, labels (bands, rules, imputation, fixed and tercile labels)."""

from __future__ import annotations

# Factor names in their order, and the labels by rank.
FACTORS = ("fin_form", "tam_osszeg", "konzorcium", "bead_napok", "max_tam_int", "eloleg", "idotartam", "tam_tevekenyseg", "egysz_elszam", "biztositek")
LABELS = ("low", "medium", "high")
# Points by upper edge; (factor, points, low, low included, high, high included).
BANDS = (
    ("tam_osszeg", 0, None, 1, 100_000_000, 1), ("tam_osszeg", 1, 100_000_000, 0, 300_000_000, 1), ("tam_osszeg", 2, 300_000_000, 0, 600_000_000, 1), ("tam_osszeg", 3, 600_000_000, 0, None, 1),
    ("bead_napok", 3, None, 1, 7, 1), ("bead_napok", 2, 7, 0, 15, 1), ("bead_napok", 1, 15, 0, 30, 1), ("bead_napok", 0, 30, 0, None, 1),
    ("max_tam_int", 0, None, 1, 30, 1), ("max_tam_int", 1, 30, 0, 50, 1), ("max_tam_int", 2, 50, 0, 70, 0), ("max_tam_int", 3, 70, 1, None, 1),
    ("eloleg", 0, None, 1, 30, 1), ("eloleg", 1, 30, 0, 50, 1), ("eloleg", 2, 50, 0, 70, 1), ("eloleg", 3, 70, 0, None, 1),
    ("idotartam", 0, None, 1, 12, 1), ("idotartam", 1, 12, 0, 18, 1), ("idotartam", 2, 18, 0, 24, 1), ("idotartam", 3, 24, 0, None, 1),
)


def factor_rows() -> str:
    return ", ".join(f"({i}, '{f}')" for i, f in enumerate(FACTORS))


def band_rows() -> str:
    number = lambda x: "cast(null as decimal(20,2))" if x is None else f"cast({x} as decimal(20,2))"
    return ", ".join(f"('{f}', {p}, {number(lo)}, {li}, {number(hi)}, {hi_in})" for f, p, lo, li, hi, hi_in in BANDS)


def banded(factor: str, v: str, sentinel: int | None = None) -> str:
    """Points of a value by the factor's bands, in their order of values; -1 stands for a sentinel."""
    rising = [b for b in BANDS if b[0] == factor]
    steps = "".join(f" when {v} {'<=' if hi_in else '<'} {hi} then {p}" for _, p, _, _, hi, hi_in in rising[:-1])
    return f"case{'' if sentinel is None else f' when {v} = -1 then {sentinel}'}{steps} else {rising[-1][1]} end"


def documents(D) -> str:
    """CTEs li, docs: one row per document (order) with its ten factor values; -1 stands for a sentinel."""
    return f"""
li as (select l_orderkey, count(distinct l_suppkey) ns, min(l_shipdate) ship, max(l_discount) d, max(l_tax) t, count(*) n,
    max(case when l_returnflag = 'R' then 1 else 0 end) r, max(case when p_type in ('ECONOMY', 'STANDARD') then 0 when p_type in ('SMALL', 'MEDIUM') then 2 else 3 end) act
  from lineitem join part on l_partkey = p_partkey group by l_orderkey),
docs as (select o_orderkey doc_id, c_mktsegment programme, r_name period,
    case o_orderstatus when 'F' then 'loan' when 'P' then 'conditional_grant' else 'grant' end fin_form,
    case when o_orderkey % 11 = 0 then null else cast(floor(o_totalprice * 1500) as bigint) end tam_osszeg,
    case when ns is null then null when ns > 1 then 1 else 0 end konzorcium,
    case when o_orderkey % 13 = 0 or ship is null then -1 else cast(abs({D.days('cast(ship as date)', 'cast(o_orderdate as date)')}) % 45 as bigint) end bead_napok,
    cast(floor(coalesce(d, 0) * 1000 + 0.5) as bigint) max_tam_int, cast(floor(coalesce(t, 0) * 1250 + 0.5) as bigint) eloleg,
    case when o_orderpriority = '1-URGENT' then -1 else cast(coalesce(n, 0) * 6 as bigint) end idotartam,
    coalesce(act, 0) tam_tevekenyseg, coalesce(r, 0) egysz_elszam, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end biztositek
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join li on l_orderkey = o_orderkey)"""


def points(D) -> str:
    """CTE pts: document x factor with value, points and origin; loan and TOP rules included."""
    return f"""{documents(D)},
factors as (select * from (values {factor_rows()}) as f(ord, factor)),
vals as (select doc_id, programme, period, fin_form, ord, factor, case factor when 'fin_form' then case fin_form when 'grant' then 3 when 'conditional_grant' then 2 else 1 end
    when 'tam_osszeg' then tam_osszeg when 'konzorcium' then konzorcium when 'bead_napok' then bead_napok when 'max_tam_int' then max_tam_int when 'eloleg' then eloleg
    when 'idotartam' then idotartam when 'tam_tevekenyseg' then tam_tevekenyseg when 'egysz_elszam' then egysz_elszam else biztositek end v from docs cross join factors),
banded as (select *, case when v is null then null
    when factor in ('fin_form', 'tam_tevekenyseg') then v when factor = 'konzorcium' then 3 * v when factor in ('egysz_elszam', 'biztositek') then 3 - 3 * v
    when factor = 'tam_osszeg' then {banded('tam_osszeg', 'v')} when factor = 'bead_napok' then {banded('bead_napok', 'v', 0)} when factor = 'max_tam_int' then {banded('max_tam_int', 'v')}
    when factor = 'eloleg' then {banded('eloleg', 'v')} else {banded('idotartam', 'v', 3)} end band from vals),
pts as (select doc_id, programme, period, fin_form, ord, factor, v,
    cast(case when factor = 'max_tam_int' and fin_form = 'loan' then 0 when v is null and factor = 'tam_osszeg' and programme = 'BUILDING' then 1 when v is null and factor = 'tam_osszeg' and programme = 'MACHINERY' then 2 else band end as bigint) points,
    case when factor = 'max_tam_int' and fin_form = 'loan' then 'loan_rule' when v is null and factor = 'tam_osszeg' and programme in ('BUILDING', 'MACHINERY') then 'top_rule' when v is null then 'mean' else 'band' end origin from banded)"""


def totals(D) -> str:
    """CTE totals: exact total of a document as num / den, den the product of the imputed factors' counts.

    Only tam_osszeg and konzorcium can be missing, so a total is whole points plus means s1/n1, s2/n2."""
    return f"""{points(D)},
means as (select factor, cast(sum(points) as bigint) s, count(*) n from pts where origin = 'band' group by factor),
wide as (select doc_id, programme, period, fin_form, {banded('tam_osszeg', 'tam_osszeg')} pt, tam_osszeg, konzorcium,
    case fin_form when 'grant' then 3 when 'conditional_grant' then 2 else 1 end + {banded('bead_napok', 'bead_napok', 0)} + case when fin_form = 'loan' then 0 else {banded('max_tam_int', 'max_tam_int')} end
    + {banded('eloleg', 'eloleg')} + {banded('idotartam', 'idotartam', 3)} + tam_tevekenyseg + 3 - 3 * egysz_elszam + 3 - 3 * biztositek others from docs),
ab as (select cast(sum(case when tam_osszeg is not null then pt end) as bigint) sa, count(tam_osszeg) na, cast(sum(3 * konzorcium) as bigint) sb, count(konzorcium) nb from wide),
sums as (select doc_id, programme, period, cast(others + case when tam_osszeg is not null then pt when programme = 'BUILDING' then 1 when programme = 'MACHINERY' then 2 else 0 end + coalesce(3 * konzorcium, 0) as bigint) p, case when tam_osszeg is null and programme not in ('BUILDING', 'MACHINERY') then 1 else 0 end ma, case when konzorcium is null then 1 else 0 end mb,
    cast(10 - case when fin_form = 'loan' then 1 else 0 end - case when tam_osszeg is null then 1 else 0 end - case when konzorcium is null then 1 else 0 end as bigint) n_determined from wide),
totals as (select doc_id, programme, period, n_determined, cast(p as decimal(38,0)) * na * nb + ma * cast(sa as decimal(38,0)) * nb + mb * cast(sb as decimal(38,0)) * na num, cast(na as decimal(38,0)) * nb den from sums cross join ab)"""


def ranked(D) -> str:
    """CTE labels: totals with fixed label and tie-safe tercile. Ranks count distinct totals first, so no window spans all rows."""
    return f"""{totals(D)},
scores as (select num, count(*) m from totals group by num),
cum as (select num, cast(sum(m) over (order by num) as bigint) c, cast(sum(m) over () as bigint) n from scores),
adm as (select c, n from cum union select cast(0 as bigint), max(n) from cum),
k1 as (select min_by(c, {D.st}(abs(3 * c - n), c)) c1 from adm),
k2 as (select min_by(c, {D.st}(abs(3 * c - 2 * n), c)) c2 from adm cross join k1 where c >= c1),
labels_ as (select t.doc_id, t.programme, t.period, t.n_determined, t.num, t.den, cast(floor((20 * t.num + 3 * t.den) / (6 * t.den)) as bigint) rounded, case when cum.c <= c1 then 'low' when cum.c <= c2 then 'medium' else 'high' end tercile
  from totals t join cum on t.num = cum.num cross join k1 cross join k2),
labelled as (select *, case when rounded <= 33 then 'low' when rounded <= 66 then 'medium' else 'high' end fixed from labels_)"""


SQL = {
    "risk_labels_flagship": lambda D: f"with {ranked(D)} select fixed, tercile, count(*) docs, cast(min(rounded) as bigint) low_score, cast(max(rounded) as bigint) high_score from labelled group by fixed, tercile",
    "document_labels": lambda D: f"with {ranked(D)} select doc_id, n_determined, case when n_determined < 5 then 1 else 0 end low_coverage, cast(num as double) / cast(den as double) total, rounded, fixed, tercile from labelled",
    "factor_points_bands": lambda D: f"with {points(D)} select factor, points, origin, count(*) n from pts group by factor, points, origin",
    "band_range_join": lambda D: f"""with {points(D)}, bands as (select * from (values {band_rows()}) as b(bf, bp, lo, li, hi, hin))
select factor, bp points, count(*) n, cast(sum(case when points = bp then 1 else 0 end) as bigint) same from pts join bands on factor = bf and v is not null and v >= 0
  and (lo is null or v > lo or (li = 1 and v = lo)) and (hi is null or v < hi or (hin = 1 and v = hi)) where origin = 'band' group by factor, bp""",
    "loan_top_rules": lambda D: f"with {points(D)} select programme, fin_form, origin, points, count(*) n from pts where origin in ('loan_rule', 'top_rule') group by programme, fin_form, origin, points",
    "factor_means_exact": lambda D: f"with {totals(D)} select factor, s num, n den, round(cast(s as double) / n, 9) mean from means",
    "coverage_by_origin": lambda D: f"with {points(D)} select factor, origin, count(*) n from pts group by factor, origin",
    "coverage_histogram": lambda D: f"with {totals(D)} select n_determined, count(*) docs from totals group by n_determined",
    "tercile_cuts": lambda D: f"with {ranked(D)} select c1, c2, (select cast(max(n) as bigint) from cum) n, (select cast(max(num) as double) / cast(max(den) as double) from labelled where tercile = 'low') last_low, (select cast(max(num) as double) / cast(max(den) as double) from labelled where tercile = 'medium') last_medium from k1 cross join k2",
    "fixed_label_counts": lambda D: f"with {ranked(D)} select period, fixed, count(*) n from labelled group by period, fixed",
    "competition_ranks": lambda D: f"with {totals(D)}, s as (select num, count(*) m from totals group by num), r as (select num, m, 1 + coalesce(cast(sum(m) over (order by num desc rows between unbounded preceding and 1 preceding) as bigint), 0) place from s) select t.doc_id, r.place, r.m tied from totals t join r on t.num = r.num",
    "domain_violations": lambda D: f"""with {points(D)}, e as (select doc_id, factor, case when v is null then null when factor = 'tam_osszeg' and v < 0 then 'negative' when factor = 'tam_osszeg' and v > 700000000 then 'over ceiling' when factor in ('max_tam_int', 'eloleg') and (v < 0 or v > 95) then 'not a percentage'
  when factor = 'idotartam' and v <> -1 and v <= 0 then 'not positive' when factor in ('konzorcium', 'egysz_elszam', 'biztositek') and v not in (0, 1) then 'not a flag' end problem from pts) select doc_id, factor, problem from e where problem is not null""",
    "label_distributions": lambda D: f"""with {ranked(D)}, space as (select subset, tercile, fixed from (select distinct period subset from labelled union select 'all') s cross join (select * from (values ('low'), ('medium'), ('high')) as x(tercile)) x cross join (select * from (values ('low'), ('medium'), ('high')) as y(fixed)) y),
c as (select coalesce(period, 'all') subset, tercile, fixed, count(*) n from labelled group by grouping sets ((period, tercile, fixed), (tercile, fixed))) select s.subset, s.tercile, s.fixed, coalesce(n, 0) n from space s left join c on s.subset = c.subset and s.tercile = c.tercile and s.fixed = c.fixed""",
    "imputed_lists": lambda D: f"with {points(D)} select doc_id, {D.join(f'array_sort({D.list_of}(factor))' if D.idiv == 'div' else 'list_sort(list(factor))', repr(','))} imputed, count(*) n from pts where origin = 'mean' group by doc_id",
}
