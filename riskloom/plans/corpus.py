"""Corpus and text operators: de-duplication, versions, codes, page cleaning, evidence, features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.cleaning import converted
from riskloom.functions.dialect import Spark
from riskloom.functions.evidence import found_in
from riskloom.operators.evidence import small, stored
from riskloom.sources.tables import CATALOGUE, catalogue, table

#: Accented Hungarian and western letters and their plain forms (fixed values).
ACCENTED, PLAIN = "áàâäéèêëíìîïóòôöőúùûüűçñ", "aaaaeeeeiiiiooooouuuuucn"


def lines(D) -> str:
    return f"lines as (select doc_id, i, line from documents {D.each_at(D.split('text', chr(92) + 'n'), 'line', 'i')})"


def blank_runs(D) -> str:
    return f"{lines(D)}, t as (select doc_id, i, rtrim(line) line, case when trim(line) = '' then 1 else 0 end blank from lines), k as (select *, lag(blank) over (partition by doc_id order by i) before from t)"


# What names of annexes, templates, guides, deeds and forms hold; lines of a title.
NON_CALL = "utmutato|mellekl|sablon|minta|szerzod|okirat|aszf|segedlet|kerdoiv|adatlap|nyomtatvany|eljarasi-rend|kezikonyv|tajekoztato|mutato|tsm|cash-flow|likviditasi|import|(^|-)to(-|[.]pdf$)"
TITLE_LINES = 8


def typed(D) -> str:
    """CTE typed: folded file names, and the first lines of page 1 without white space."""
    fold = lambda x: f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"
    name = "concat(case doc_id % 9 when 0 then 'Útmutató-' when 1 then 'Pályázati_FELHÍVÁS-' when 2 then 'termékleírás-' when 3 then 'GINOP-to-' else 'doc-' end, cast(doc_id as varchar(20)), '.pdf')"
    page = "concat(case doc_id % 4 when 0 then concat('F', chr(10), 'ELHÍVÁS', chr(10)) when 1 then concat(chr(10), 'Termék leírás', chr(10)) else '' end, text)"
    lines_ = D.keep(D.map(D.split(page, chr(92) + 'n'), 'x', 'trim(x)'), 'x', 'length(x) > 0')
    head = D.slice(lines_, 1, TITLE_LINES)
    return f"typed as (select doc_id, {fold(name)} name, {D.swap(fold(D.join(head, repr(' '))), '[ ]+', '')} title from documents where text is not null)"


def tokens(D) -> str:
    return f"tok as (select doc_id, w from documents {D.each(D.found('lower(text)', '[a-z]{2,}'), 'w')})"


def tfidf(D) -> str:
    return f"""{tokens(D)}, tf as (select doc_id, w, count(*) c from tok group by doc_id, w), train as (select distinct doc_id from tf where doc_id % 5 <> 0), nn as (select count(*) n from train),
df as (select w, count(*) df from tf where doc_id % 5 <> 0 group by w having count(*) >= 5), keep as (select w, df from df cross join nn where df <= 0.95 * n),
x as (select tf.doc_id, tf.w, (1 + ln(c)) * (ln((1.0 + n) / (1.0 + df)) + 1) v from tf join keep on tf.w = keep.w cross join nn), l2 as (select doc_id, sqrt(sum(v * v)) s from x group by doc_id)"""


CODE = {"raw": "concat('  ', upper(substr(c_mktsegment, 1, 4)), case when c_custkey % 3 = 0 then ' Plusz' when c_custkey % 3 = 1 then '_PLUSZ' else '' end, ' - ', cast(c_nationkey as varchar(10)), '.', cast(c_custkey % 7 as varchar(10)), '.1', case when c_custkey % 2 = 0 then '.-16' else ' -2017' end, case when c_custkey % 5 = 0 then '.' else '' end)"}


def codes(D) -> str:
    a = D.swap("trim(raw)", "[ _]+[Pp][Ll][Uu][Ss][Zz]", "_PLUSZ")
    b = D.swap(a, "[ ]+", "")
    return f"raws as (select c_custkey, {CODE['raw']} raw from customer), codes as (select c_custkey, raw, rtrim({D.swap('upper(' + b + ')', '[.]-', '-')}, '.') code from raws)".replace("rtrim(" + D.swap('upper(' + b + ')', '[.]-', '-') + ", '.')", D.swap(D.swap('upper(' + b + ')', '[.]-', '-'), '[.]+$', ''))


#: Canonical JSON (sorted keys, no blanks) of what a vector was made from.
CACHE_KEY = """concat('{"label":', cast(label as varchar(20)), ',"vec_id":', cast(vec_id as varchar(20)), '}')"""
MONEY = "concat(cast(cast(floor(o_totalprice) as bigint) as varchar(20)), case when o_orderkey % 4 = 0 then ' Ft' when o_orderkey % 4 = 1 then ' ezer forint' when o_orderkey % 4 = 2 then ',25 millió forint' else ',5 Mrd Ft' end)"

SQL = {
    "normalise_codes": lambda D: f"with {codes(D)} select c_custkey, code, {D.swap('code', '-([0-9]{4}|[0-9]{2})$', '')} series, {D.first('code', '^([A-Z]+(?:_PLUSZ)?)', 1)} programme from codes",
    "programme_counts": lambda D: f"with {codes(D)}, p as (select {D.first('code', '^([A-Z]+(?:_PLUSZ)?)', 1)} programme from codes) select programme, count(*) n, case when programme like '%PLUSZ' then 1 else 0 end plus from p group by programme",
    "exact_duplicates_first_wins": lambda D: "with r as (select doc_id, text, row_number() over (partition by md5(text) order by case when source = 'src0' then 0 else 1 end, doc_id) k, count(*) over (partition by md5(text)) n from documents) select doc_id, n copies, substr(md5(text), 1, 16) hash from r where k = 1",
    "content_conflicts": lambda D: "select source, n_chars, count(distinct md5(text)) contents from documents group by source, n_chars having count(distinct md5(text)) > 1",
    "version_choice": lambda D: """with c as (select o_orderkey id, o_custkey call, cast(o_totalprice / 20000 as bigint) marker, case when o_orderkey % 6 = 0 then 0 else 1 end readable from orders),
r as (select *, count(*) over (partition by call, marker) ties, row_number() over (partition by call order by marker desc, id) k from c),
b as (select *, max(case when ties > 1 then 1 else 0 end) over (partition by call order by marker desc, id rows between unbounded preceding and current row) bad from r),
p as (select call, min(case when readable = 1 then k end) k from b group by call) select b.call, b.id, b.marker, b.bad unclear from b join p on b.call = p.call and b.k = p.k""".replace("cast(o_totalprice / 20000 as bigint)", "cast(floor(o_totalprice / 20000) as bigint)"),
    "fold_accents": lambda D: f"select doc_id, translate(lower(substr(text, 1, 1000000)), '{ACCENTED}', '{PLAIN}') folded from documents".replace("substr(text, 1, 1000000)", "text"),
    "document_types": lambda D: f"with {typed(D)} select doc_id, case when {D.like('name', NON_CALL)} then 'other' when name like '%termekleir%' then 'product_description' when name like '%felhiv%' then 'main_call' when title like '%termekleiras%' then 'product_description' when title like '%felhivas%' then 'main_call' else 'unknown' end kind from typed",
    "tidy_whitespace": lambda D: f"with {blank_runs(D)} select doc_id, count(case when blank = 0 or coalesce(before, 1) = 0 then 1 end) kept, count(case when blank = 1 and coalesce(before, 1) = 1 then 1 end) dropped from k group by doc_id",
    "table_lines": lambda D: f"with {lines(D)} select doc_id, count(case when line like '%|%' then 1 end) table_lines, count(*) n, count(case when {D.like('line', '^[|][- |:]+[|]?$')} then 1 end) separators from lines group by doc_id",
    "text_warnings": lambda D: f"select doc_id, case when length(text) < 8000 then 1 else 0 end low_text, case when {D.like('text', '[#$%&*]{3}')} then 1 else 0 end suspect, cast(length(text) as bigint) characters from documents",
    "page_split": lambda D: f"with h as (select page_id, html from pages), p as (select page_id, i, part from h {D.each_at(D.split('html', '<p>'), 'part', 'i')}) select page_id, cast(i as bigint) page, trim({D.swap('part', '<[^>]*>', ' ')}) text from p",
    "html_plain_text": lambda D: f"select page_id, trim({D.swap(D.swap('html', '<[^>]*>', ' '), '[ ]+', ' ')}) plain from pages",
    "cells_on_one_line": lambda D: f"with {lines(D)} select doc_id, cast(i as bigint) line_no, case when ltrim(line) like '|%' then {D.swap('line', '<br */?>', ' ')} else line end line from lines where line like '%|%'",
    "money_values": lambda D: f"""with m as (select o_orderkey, {MONEY} t from orders), x as (select o_orderkey, t, {D.first('t', '^([0-9]+)', 1)} whole, {D.first('t', ',([0-9]+)', 1)} part from m)
select o_orderkey, cast(cast(concat(whole, '.', case when part = '' then '0' else part end) as decimal(20,4)) * case when t like '%millió%' then 1000000 when t like '%Mrd%' then 1000000000 when t like '%ezer%' then 1000 else 1 end as bigint) amount from x""",
    "date_values": lambda D: f"with m as (select o_orderkey, concat(cast(year(o_orderdate) as varchar(5)), '. ', lpad(cast(month(o_orderdate) as varchar(5)), 2, '0'), '. ', lpad(cast(o_orderkey % 33 as varchar(5)), 2, '0'), '.') t from orders), x as (select o_orderkey, t, {D.swap('t', '[. ]+', '-')} d from m) select o_orderkey, cast(try_cast(substr(d, 1, 10) as date) as varchar(10)) day from x".replace("as varchar(10)) day", "as varchar(10)) iso_day"),
    "month_spans": lambda D: f"with m as (select o_orderkey, cast(o_orderdate as date) a, cast(l_shipdate as date) b from orders join lineitem on o_orderkey = l_orderkey and l_linenumber = 1) select o_orderkey, min(360 * (year(b) - year(a)) + 30 * (month(b) - month(a)) + (day(b) - day(a))) thirtieths from m group by o_orderkey".replace("min(360", "min(cast(360").replace("(day(b) - day(a)))", "(day(b) - day(a)) as bigint))"),
    "date_periods": lambda D: f"with e as (select user_id, event_id, cast(ts as date) d, row_number() over (partition by user_id order by ts, event_id) k from events) select a.user_id, min({D.days('b.d', 'a.d')}) shortest, count(*) periods from e a join e b on a.user_id = b.user_id and a.k % 2 = 1 and b.k = a.k + 1 group by a.user_id".replace("min(", "min(cast(").replace(") shortest", " as bigint)) shortest"),
    "nearest_centroid": lambda D: f"with {tfidf(D)}, lab as (select doc_id, max(quality) y from labels group by doc_id), c as (select y, w, sum(v / s) v from x join l2 on x.doc_id = l2.doc_id join lab on x.doc_id = lab.doc_id where x.doc_id % 5 <> 0 group by y, w), q as (select y, sqrt(sum(v * v)) s from c group by y), sc as (select x.doc_id, c.y, round(sum(x.v * c.v) / max(l2.s * q.s), 9) cosine from x join c on x.w = c.w join l2 on x.doc_id = l2.doc_id join q on q.y = c.y join lab on lab.doc_id = x.doc_id where x.doc_id % 5 = 0 group by x.doc_id, c.y) select doc_id, max_by(y, {D.st}(cosine, y)) predicted, round(max(cosine), 6) cosine from sc group by doc_id",
    "chunk_plan": lambda D: f"with n as (select doc_id, {D.size}({D.split_re('text', '[ ]+')}) n from documents), k as (select doc_id, n, cast(floor((n + 255) / 256) as bigint) k from n) select doc_id, cast(k as bigint) chunks, cast(n - 256 * (k - 1) as bigint) last_chunk from k",
    "cache_keys": lambda D: f"select vec_id, {D.sha256(CACHE_KEY)} cache_key from embeddings",
    "hashed_texts": lambda D: "select doc_id, substr(md5(trim(text)), 1, 16) text_hash, cast(length(text) as bigint) n from documents",
    "number_format": lambda D: f"select p_partkey, replace(cast(cast(p_retailprice as decimal(12,2)) as varchar(20)), '.', ',') shown from part",
}


def nearest_centroid(spark, sf_dir):
    """Texts are read and counted once, where they lie; vocabulary and centroids go to the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    tok = docs.select("doc_id", F.explode(F.expr(Spark.found("lower(text)", "[a-z]{2,}"))).alias("w"))
    counts = stored(tok.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("c")))
    train = counts.where("doc_id % 5 <> 0")
    n = train.select("doc_id").distinct().count()
    known = small(stored(train.groupBy("w").agg(F.count(F.lit(1)).alias("df")).where(f"df >= 5 and df <= 0.95 * {n}").select("w", F.expr(f"ln((1.0 + {n}) / (1.0 + df)) + 1").alias("idf"))))
    lab = small(stored(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("y"))))
    x = counts.join(lab, "doc_id").join(known, "w").select("doc_id", "y", "w", ((1 + F.log("c")) * F.col("idf")).alias("v"))
    x = stored(x.select("doc_id", "y", "w", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))).alias("u")))
    c = stored(x.where("doc_id % 5 <> 0").groupBy("y", "w").agg(F.sum("u").alias("v")))
    q = c.groupBy("y").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("s"))  # a row a class
    c = small(stored(c.join(q, "y").select("y", "w", (F.col("v") / F.col("s")).alias("v"))))
    met = x.where("doc_id % 5 = 0").select("doc_id", "w", "u").join(c, "w").groupBy("doc_id", "y").agg(F.round(F.sum(F.col("u") * F.col("v")), 9).alias("cosine"))
    return met.groupBy("doc_id").agg(F.max_by("y", F.struct("cosine", "y")).alias("predicted"), F.round(F.max("cosine"), 6).alias("cosine"))


def _learners(name):
    def run(spark, sf_dir):
        from riskloom.operators import learners

        return getattr(learners, name)(table(spark, sf_dir, "embeddings"))

    return run


def paged(documents, lines: int = 40):
    """Documents as arrays of pages of `lines` lines, as a converter would give them."""
    cut = documents.selectExpr("doc_id", "split(coalesce(text, ''), '\n') held")
    return cut.selectExpr("doc_id", f"transform(sequence(0, size(held) - 1, {lines}), i -> array_join(slice(held, i + 1, {lines}), '\n')) pages")


ORACLE = {"catalogue": CATALOGUE}
QUERIES = {
    "catalogue": catalogue,
    "nearest_centroid": nearest_centroid,
    "clean_documents": lambda spark, sf_dir: converted(paged(table(spark, sf_dir, "documents"))),
    "quote_pages": lambda spark, sf_dir: found_in(converted(paged(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark")),
    "cv_logistic_regression": _learners("cross_validated_logreg"),
    "cv_tuned_regression": _learners("cross_validated_tuned"),
    "cv_random_forest": _learners("cross_validated_forest"),
    "cv_kernel_machine": _learners("cross_validated_kernel"),
    "cv_ridge_regression": _learners("cross_validated_ridge"),
    "cv_grouped_regression": _learners("grouped_logreg"),
    "factor_probes": _learners("factor_probes"),
}
