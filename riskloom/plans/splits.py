"""Folds by series, chunks of texts with their spans, and periods between dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators.folds import MOST, assigned, grouped_folds
from riskloom.operators.spans import PIECE, WHITE, chunked, periods
from riskloom.sources.tables import table

CLASSES, BUDGET = ("low", "medium", "high"), 256


def _labelled(spark, sf_dir):
    """Labelled documents with their series: documents of one source, in thirteen lots."""
    label = "case when max(quality) = 0 then 'high' when max(toxic) = 1 then 'medium' else 'low' end"
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.expr(label).alias("label"))
    docs = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("source").alias("source"))
    return marks.join(docs, "doc_id", "left").selectExpr("doc_id", "label", "concat(coalesce(source, ''), ' ', cast(doc_id div 20 % 13 as string)) series")


def stratified_grouped_folds(spark, sf_dir):
    """Repeat and fold of every labelled document; a series is whole in one fold, classes are as even as series allow."""
    rows = _labelled(spark, sf_dir)
    return assigned(rows, "series", grouped_folds(rows, "series", "label", CLASSES)).select(F.col("rep").cast("long").alias("rep"), "doc_id", "series", "label", F.col("fold").cast("long").alias("fold"))


def grouped_fold_classes(spark, sf_dir):
    """Documents and series of each class in each fold and repeat."""
    rows = stratified_grouped_folds(spark, sf_dir).groupBy("rep", "fold", "label", "series").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("rep", "fold", "label").agg(F.count(F.lit(1)).alias("series"), F.sum("n").alias("documents"))


def chunk_spans(spark, sf_dir):
    """Every document's chunks: tokens, character spans, and the MD5 of what lies between."""
    return chunked(table(spark, sf_dir, "documents"), BUDGET).selectExpr("doc_id", "cast(chunk as bigint) chunk", "cast(first_token as bigint) first_token", "cast(tokens as bigint) tokens", "cast(start as bigint) start", "cast(stop as bigint) stop", "md5(cast(body as binary)) body")


#: What stands between the dates of a line, by its return flag: joined, apart, closed, joined around an impossible date.
BETWEEN = (("A", " - "), ("N", ", "), ("R", "-ig, "))
THIRD = (("A", " – "), ("N", "-tól "), ("R", " - 2023. 02. 31. "))


def _by_flag(column: str, words: tuple) -> str:
    return f"case {column} " + " ".join(f"when '{f}' then '{w}'" for f, w in words) + f" else '{words[0][1]}' end"


def order_periods(spark, sf_dir):
    """Periods in a text of four dates a line (ordered, shipped, quantity days after the order, thirty after shipping): how many, shortest, sum."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").selectExpr("o_orderkey l_orderkey", "cast(o_orderdate as date) o", "o_orderstatus"), "l_orderkey")
    lines = lines.selectExpr("l_orderkey", "l_linenumber", "l_returnflag f", "o_orderstatus s", "o", "cast(l_shipdate as date) d", "cast(l_quantity as int) q")
    text = f"concat('Benyújtás: ', date_format(o, 'yyyy. MM. dd'), {_by_flag('f', BETWEEN)}, date_format(d, 'yyyy-MM-dd'), case when s = 'F' then '-tól ' else ' / ' end, date_format(date_add(o, q), 'yyyy.M.d'), {_by_flag('f', THIRD)}, date_format(date_add(d, 30), 'yyyy. M. d'), '.')"
    found = lines.withColumn("t", F.expr(text)).withColumn("p", periods(F.col("t")))  # a text is put together once
    return found.selectExpr("l_orderkey", "l_linenumber", "cast(size(p) as bigint) periods", "cast(array_min(p.days) as bigint) shortest", "aggregate(p.days, 0L, (a, x) -> a + x) total_days")


QUERIES = {"stratified_grouped_folds": stratified_grouped_folds, "grouped_fold_classes": grouped_fold_classes, "chunk_spans": chunk_spans, "order_periods": order_periods}

# DuckDB, another way: the greedy balance as a recursion, chunks by grouping tokens, periods by cases.
_COST = " + ".join("(n[3 * f + {i}] * {c})::double / greatest(t{c} * t{c}, 1)".format(i=i + 1, c=c) for i, c in enumerate("abc"))
_FOLDS = f"""with recursive rows_ as (select m.doc_id, label, concat(coalesce(source, ''), ' ', cast(m.doc_id // 20 % 13 as varchar)) series from (select doc_id, case when max(quality) = 0 then 'high' when max(toxic) = 1 then 'medium' else 'low' end label from labels group by doc_id) m left join (select doc_id, min(source) source from documents group by doc_id) d on m.doc_id = d.doc_id),
vec as (select series, count(*) filter (label = 'low') a, count(*) filter (label = 'medium') b, count(*) filter (label = 'high') c from rows_ group by series),
total as (select sum(a)::bigint ta, sum(b)::bigint tb, sum(c)::bigint tc from vec),
keyed as (select rep, series, a, b, c, md5(concat('42:', rep, ':', series)) tie from vec cross join (select unnest(generate_series(0, 4)) rep) r),
ranked as (select *, row_number() over (partition by rep, a, b, c order by tie, series) nth, count(*) over (partition by rep, a, b, c) m from keyed),
rest as (select *, row_number() over (partition by rep order by a + b + c desc, tie, series) i from ranked where nth > m - m % 5),
small as (select *, row_number() over (partition by rep, list_position([a, b, c], greatest(a, b, c)) order by i) - 1 p from rest where i > {MOST}),
dealt as (select rep, series, a, b, c, (nth - 1) % 5 fold from ranked where nth <= m - m % 5 union all select rep, series, a, b, c, case when p // 5 % 2 = 0 then p % 5 else 4 - p % 5 end from small),
grid as (select rep, fold from (select unnest(generate_series(0, 4)) rep) r cross join (select unnest(generate_series(0, 4)) fold) f),
begun as (select rep, flatten(list([na, nb, nc] order by fold)) n from (select g.rep, g.fold, coalesce(sum(a), 0)::bigint na, coalesce(sum(b), 0)::bigint nb, coalesce(sum(c), 0)::bigint nc from grid g left join dealt d on d.rep = g.rep and d.fold = g.fold group by g.rep, g.fold) z group by rep),
greedy(rep, i, n, series, fold) as (select rep, 0::bigint, n, null::varchar, null::bigint from begun
 union all select rep, i, [case when (k - 1) // 3 = best then n[k] + case (k - 1) % 3 when 0 then a when 1 then b else c end else n[k] end for k in generate_series(1, 15)], series, best
 from (select *, list_position(costs, list_min(costs))::bigint - 1 best from (select g.rep, r.i, g.n, r.series, r.a, r.b, r.c, [{_COST} for f in generate_series(0, 4)] costs from greedy g join rest r on r.rep = g.rep and r.i = g.i + 1 and r.i <= {MOST} cross join total) y) z),
fold as (select rep, series, fold from dealt union all select rep, series, fold from greedy where i > 0)"""
_OK = {"12": f"f = 'A' and d2 > d1", "23": "s = 'F' and d3 > d2", "34": "d4 > d3"}
ORACLE = {
    "stratified_grouped_folds": f"{_FOLDS} select rep, doc_id, r.series, label, fold from rows_ r join fold f on r.series = f.series",
    "grouped_fold_classes": f"{_FOLDS} select rep, fold, label, count(distinct r.series) series, count(*) documents from rows_ r join fold f on r.series = f.series group by rep, fold, label",
    "chunk_spans": rf"""with t as (select row_number() over () rid, doc_id, coalesce(text, '') x from documents), p as (select rid, doc_id, x, regexp_extract_all(x, '{PIECE}') p, regexp_extract(x, '^[{WHITE}]*') head from t),
w as (select rid, doc_id, unnest(p) w, generate_subscripts(p, 1) - 1 k from p),
c as (select rid, doc_id, k // {BUDGET} chunk, min(k) first_token, count(*) tokens, string_agg(w, '' order by k) body from w group by all),
b as (select c.rid, c.doc_id, chunk, first_token, tokens, case when chunk = 0 then head || body else body end body from c join p on c.rid = p.rid union all select rid, doc_id, 0, 0, 0, x from p where len(p) = 0)
select doc_id, chunk, first_token, tokens, coalesce(sum(length(body)) over (partition by rid order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint start, (sum(length(body)) over (partition by rid order by chunk))::bigint stop, md5(body) body from b""",
    "order_periods": f"""with l as (select l_orderkey, l_linenumber, l_returnflag f, o_orderstatus s, o_orderdate::date d1, l_shipdate::date d2, o_orderdate::date + l_quantity::int d3, l_shipdate::date + 30 d4 from lineitem join orders on o_orderkey = l_orderkey),
p as (select *, case when {_OK['12']} then case when {_OK['34']} then [d2 - d1, d4 - d3] else [d2 - d1] end when {_OK['23']} then [d3 - d2] when {_OK['34']} then [d4 - d3] else [] end p from l)
select l_orderkey, l_linenumber, len(p) periods, list_min(p)::bigint shortest, coalesce(list_sum(p), 0)::bigint total_days from p""",
}
