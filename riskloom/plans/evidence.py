"""Quotes found in paged documents, pages of occurrences, and pages without their furniture.

A page is LINES lines of a document. Every benchmark item is a quote as it is, and once more with its middle left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators.evidence import as_of, kept, search, worded
from riskloom.operators.furniture import EDGE, SHARE, without_furniture
from riskloom.sources.tables import table

LINES, ENDS = 5, 40


def paged(documents, lines: int = LINES):
    """doc_id and pages: a document's text in arrays of `lines` lines."""
    cut = documents.selectExpr("doc_id", "split(coalesce(text, ''), '\n') held")
    return cut.selectExpr("doc_id", f"transform(sequence(0, size(held) - 1, {lines}), i -> array_join(slice(held, i + 1, {lines}), '\n')) pages")


def _forms(benchmark):
    """Items as quotes 2 * item_id, and with all but ENDS characters at each end left out as 2 * item_id + 1."""
    forms = benchmark.selectExpr("item_id", f"posexplode(array(text, concat(substr(text, 1, {ENDS}), ' […] ', right(text, {ENDS})))) as (form, quote)")
    return forms.selectExpr("2 * item_id + form item_id", "quote text")


def occurrences(spark, sf_dir):
    return search(paged(table(spark, sf_dir, "documents")), _forms(table(spark, sf_dir, "benchmark")))


def evidence_pages(spark, sf_dir):
    """Every occurrence of every item, whole or shortened: item, form (0 whole, 1 shortened), document, word and page."""
    return occurrences(spark, sf_dir).selectExpr("quote div 2 item_id", "cast(quote % 2 as int) form", "key doc_id", "cast(place as bigint) place", "cast(page as bigint) page")


def evidence_audit(spark, sf_dir):
    """By form and over all: quotes, those found in a document, documents that hold them, occurrences."""
    asked = _forms(table(spark, sf_dir, "benchmark"))
    hits = occurrences(spark, sf_dir).groupBy("quote", "key").agg(F.count(F.lit(1)).alias("n"))
    by_quote = hits.groupBy("quote").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))
    each = asked.join(by_quote, F.col("item_id") == F.col("quote"), "left").selectExpr("cast(item_id % 2 as int) form", "case when n is null then 0 else 1 end hit", "coalesce(documents, 0) documents", "coalesce(n, 0) n")
    return each.rollup("form").agg(F.count(F.lit(1)).alias("quotes"), F.sum("hit").cast("long").alias("found"), F.sum("documents").alias("documents"), F.sum("n").alias("occurrences"))


def as_of_pages(spark, sf_dir):
    """The page of every tenth word of every document: the last page that starts at or before it."""
    texts = kept(worded(paged(table(spark, sf_dir, "documents"))))
    marks = texts.select(F.col("key").alias("doc_id"), F.posexplode("starts").alias("page", "word")).selectExpr("doc_id", "cast(word as bigint) word", "cast(page + 1 as bigint) page")
    places = texts.selectExpr("key doc_id", "explode(sequence(0, greatest(size(words) - 1, 0), 10)) word", "size(words) n").where("n > 0").selectExpr("doc_id", "cast(word as bigint) word")
    return as_of(places, marks, "doc_id", "word", "page", 1000)


def last_signup(spark, sf_dir):
    """Each event's last signup of the same user at or before it (the largest id of those at one time)."""
    events = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type", "unix_micros(cast(concat(cast(ts as string), '+00:00') as timestamp)) us")
    marks = events.where("event_type = 'signup'").selectExpr("user_id", "us", "event_id last_signup")
    return as_of(events.select("user_id", "event_id", "us"), marks, "user_id", "us", "last_signup", 86_400_000_000).select("user_id", "event_id", "last_signup")


def page_furniture(spark, sf_dir):
    """Pages with the lines removed from them, and what is left."""
    rows = paged(table(spark, sf_dir, "documents")).selectExpr("doc_id", "posexplode(pages) as (page, text)").selectExpr("doc_id", "cast(page + 1 as bigint) page", "text")
    return without_furniture(rows).selectExpr("doc_id", "page", "n_lines", "n_removed", "md5(text) kept")


QUERIES = {"evidence_pages": evidence_pages, "evidence_audit": evidence_audit, "as_of_pages": as_of_pages, "last_signup": last_signup, "page_furniture": page_furniture}

# DuckDB, another way: whole strings by position, characters for words, asof joins.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(text: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(regexp_replace({text}, '[*_`]', '', 'g'), '[|#]', ' ', 'g'), '{_WHITE}', ' ', 'g')))"


_CUT = f"cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) held from documents), page as (select doc_id, i // {LINES} + 1 page, array_to_string(held[i + 1:i + {LINES}], chr(10)) body from cut, lateral (select unnest(generate_series(0, len(held) - 1, {LINES})) i) s)"
_TEXTS = f"{_CUT}, plain as (select doc_id, page, {_norm('body')} t from page), texts as (select doc_id, string_agg(t, ' ' order by page) filter (t <> '') t from plain group by doc_id), starts as (select doc_id, page, coalesce(sum(case when t = '' then 0 else len(string_split(t, ' ')) end) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) word from plain)"
_FORMS = f"forms as (select item_id, 0 form, text from benchmark union all select item_id, 1, concat(substr(text, 1, {ENDS}), ' […] ', right(text, {ENDS})) from benchmark), asked as (select item_id, form, case form when 0 then {_norm('text')} else {_norm(f'substr(text, 1, {ENDS})')} end a, case form when 1 then {_norm(f'right(text, {ENDS})')} end b from forms)"
_FOUND = f"""{_TEXTS}, {_FORMS},
met as (select item_id, form, doc_id, t, a, b, unnest(list_filter(generate_series(1, len(t)), lambda i: substr(t, i, len(a)) = a)) i from asked join texts on contains(t, a)),
hit as (select item_id, form, doc_id, len(t[1:i]) - len(replace(t[1:i], ' ', '')) place from met where b is null or contains(substr(t, i + len(a), 301 + len(b)), b))"""
ORACLE = {
    "evidence_pages": f"with {_FOUND} select item_id, form, hit.doc_id, cast(place as bigint) place, cast(page as bigint) page from hit asof join starts on hit.doc_id = starts.doc_id and hit.place >= starts.word",
    "evidence_audit": f"with {_FOUND}, n as (select item_id, form, count(distinct doc_id) documents, count(*) n from hit group by 1, 2) select asked.form, count(*) quotes, count(n) found, cast(coalesce(sum(documents), 0) as bigint) documents, cast(coalesce(sum(n), 0) as bigint) occurrences from asked left join n on asked.item_id = n.item_id and asked.form = n.form group by rollup (asked.form)",
    "as_of_pages": f"with {_TEXTS}, places as (select doc_id, unnest(generate_series(0, len(string_split(t, ' ')) - 1, 10)) word from texts where t is not null), mark as (select doc_id, word, max(page) page from starts group by 1, 2) select places.doc_id, places.word, cast(page as bigint) page from places asof join mark on places.doc_id = mark.doc_id and places.word >= mark.word",
    "last_signup": "with m as (select user_id, ts, max(event_id) last_signup from events where event_type = 'signup' group by 1, 2) select e.user_id, e.event_id, last_signup from events e asof left join m on e.user_id = m.user_id and e.ts >= m.ts",
    "page_furniture": rf"""with {_CUT}, line as (select doc_id, page, pos, line, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) bare from page, lateral (select unnest(string_split(body, chr(10))) line, generate_subscripts(string_split(body, chr(10)), 1) - 1 pos) l),
edge as (select *, row_number() over (partition by doc_id, page order by pos) up, row_number() over (partition by doc_id, page order by pos desc) down from line where bare <> '' and not starts_with(bare, '|')),
own as (select doc_id, page, pos, bare, regexp_replace(bare, '[0-9]', '#', 'g') k from edge where up <= {EDGE} or down <= {EDGE}),
furn as (select doc_id, k from own group by doc_id, k having count(distinct page) >= 2 and count(distinct page) > {SHARE} * (select count(*) from page p where p.doc_id = own.doc_id)),
gone as (select doc_id, page, pos from own where regexp_matches(bare, '^([-–]?\s*[0-9]{{1,4}}\s*[-–]?|[0-9]{{1,4}}\s*/\s*[0-9]{{1,4}})$') or exists (select 1 from furn f where f.doc_id = own.doc_id and f.k = own.k))
select l.doc_id, l.page, count(*) n_lines, count(g.pos) n_removed, md5(coalesce(string_agg(line, chr(10) order by l.pos) filter (g.pos is null), '')) kept from line l left join gone g on l.doc_id = g.doc_id and l.page = g.page and l.pos = g.pos group by l.doc_id, l.page""",
}
