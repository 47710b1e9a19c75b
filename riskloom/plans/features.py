"""TF-IDF fitted inside each training fold, n-grams and terms over whole vocabularies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions.dialect import Spark
from riskloom.operators.evidence import small, stored
from riskloom.operators.terms import term_counts, vocabularies
from riskloom.plans.models import folds
from riskloom.sources.tables import table, views

# Hungarian stop words, least documents, largest share of documents, and size of a vocabulary.
STOP_WORDS = (
    "a az egy és vagy hogy de mint ha s illetve valamint továbbá azonban viszont tehát ezért mert míg sem se is csak csupán nem ne sose soha "
    "meg el be ki fel le át rá ide oda össze szét vissza elő utána ez azok ezek ő ők aki ami amely amelyek aminek amelynek ennek annak ezt azt "
    "ezen azon minden mindegyik valamennyi néhány bármely bármi senki semmi által miatt szerint alapján részére számára esetén érdekében "
    "keretében vonatkozásában tekintetében között alatt felett mellett helyett nélkül után előtt során belül kívül iránt felé van vannak volt "
    "voltak lesz lesznek lehet kell kellett lett legyen úgy így itt ott akkor amikor ahol ahogy mind már még pedig hanem sőt azaz vagyis "
    "amennyiben illetőleg"
).split()
LEAST, LARGEST, VOCABULARY = 2, 0.9, 200_000
TOKEN = "[\\p{L}\\p{N}_]{2,}"


def tokens(D, keep: str = "") -> str:
    """CTE toks: tokens of two letters or more, stop words out, in order."""
    listed = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"toks as (select doc_id, i, w from documents {D.each_at(D.keep(D.found('lower(text)', TOKEN), 'x', f'x not in ({listed})'), 'w', 'i')} {keep})"


def fitted(D) -> str:
    """CTEs: terms of one and two tokens of labelled documents; df and idf of each fold's training documents."""
    by_fold = ", ".join(f"count(case when o.fold = {k} then 1 end) d{k}, cast(sum(case when o.fold = {k} then t.c else 0 end) as bigint) s{k}" for k in range(5))
    df, total = (" ".join(f"when {k} then {x}{k}" for k in range(5)) for x in "ds")
    return f"""{folds(D)}, own as (select doc_id, fold from folds where rep = 0),
{tokens(D, 'where doc_id in (select doc_id from own)')}, pairs_ as (select doc_id, w, lead(w) over (partition by doc_id order by i) nxt from toks),
tf as (select doc_id, term, count(*) c from (select doc_id, w term from pairs_ union all select doc_id, concat(w, ' ', nxt) from pairs_ where nxt is not null) z group by doc_id, term),
five as (select * from (values (0), (1), (2), (3), (4)) as f(f)), sizes as (select f.f, count(*) n from five f join own o on o.fold <> f.f group by f.f),
held as (select t.term, count(*) d, cast(sum(t.c) as bigint) s, {by_fold} from tf t join own o on t.doc_id = o.doc_id group by t.term having count(*) >= {LEAST}),
df as (select f.f, term, d - case f.f {df} end df, s - case f.f {total} end total from held cross join five f),
vocab as (select f, term, df, n from (select df.f, term, df, n, row_number() over (partition by df.f order by total desc, term) k from df join sizes on df.f = sizes.f where df >= {LEAST} and df <= {LARGEST} * n) z where k <= {VOCABULARY}),
idf as (select f, term, ln((1e0 + n) / (1e0 + df)) + 1 idf from vocab)"""


SQL = {
    # each labelled document's vector under the vocabulary of the folds that don't hold it
    "tfidf_features": lambda D: f"with {fitted(D)}, x as (select t.doc_id, t.term, (1 + ln(cast(t.c as double))) * idf v from tf t join own o on t.doc_id = o.doc_id join idf i on i.f = o.fold and i.term = t.term), l2 as (select doc_id, sqrt(sum(v * v)) s from x group by doc_id) select x.doc_id, x.term, round(v / s, 6) weight from x join l2 on x.doc_id = l2.doc_id",
    "tfidf_vocabulary": lambda D: f"with {fitted(D)} select cast(f as bigint) fold, term, round(idf, 9) idf from idf",
    "bigrams": lambda D: f"with {tokens(D)}, b as (select w, lead(w) over (partition by doc_id order by i) nxt from toks) select concat(w, ' ', nxt) bigram, count(*) n from b where nxt is not null group by concat(w, ' ', nxt)",
    "token_counts": lambda D: f"with {tokens(D)} select doc_id, count(*) tokens, count(distinct w) vocabulary from toks group by doc_id",
    "top_terms": lambda D: f"""with {fitted(D)}, w as (select lab.label, t.term, own.fold, sum(1 + ln(cast(t.c as double))) a from tf t join own on t.doc_id = own.doc_id join lab on lab.doc_id = own.doc_id group by lab.label, t.term, own.fold),
m as (select label, w.term, round(sum(a * idf) / 5, 9) mean, count(distinct f) folds from w join idf i on i.term = w.term and i.f <> w.fold group by label, w.term), k as (select *, row_number() over (partition by label order by mean desc, term) place from m) select label, term, mean, folds, cast(place as bigint) place from k where place <= 30""",
}


def words(text: str = "text"):
    """Lower-case words of two letters or more, stop words out, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


def _fitted(spark, sf_dir):
    """Counts of the labelled documents' terms (with fold and label), and (split, term, df, n) of each fold's vocabulary; texts are read once."""
    views(spark, sf_dir)
    own = stored(spark.sql(f"with {folds(Spark)} select doc_id, label, 0 rep, fold, fold split from folds where rep = 0"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(own.select("doc_id", "label", "fold"), "doc_id")
    counts = stored(term_counts(docs, words(), "label", "fold"))
    known = vocabularies(counts.withColumn("own", F.array("fold")), own, LEAST, LARGEST, VOCABULARY, folds=5)
    return counts, known.withColumn("idf", F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1)


def _by_term(known):
    """(term, idf): a term's idf by fold, null where the fold's vocabulary lacks it; five times VOCABULARY rows at most."""
    return small(stored(known.groupBy("term").agg(F.array(*(F.max(F.when(F.col("split") == k, F.col("idf"))) for k in range(5))).alias("idf"))))


def tfidf_features(spark, sf_dir):
    counts, known = _fitted(spark, sf_dir)
    x = counts.join(_by_term(known), "term").select("doc_id", "term", ((1 + F.log("c")) * F.get("idf", F.col("fold"))).alias("v")).where("v is not null")
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
    return x.select("doc_id", "term", F.round(F.col("v") / length, 6).alias("weight"))


def tfidf_vocabulary(spark, sf_dir):
    return _fitted(spark, sf_dir)[1].select(F.col("split").cast("long").alias("fold"), "term", F.round("idf", 9).alias("idf"))


def top_terms(spark, sf_dir):
    """A term's sums by label and fold of its documents stand in one row, so a fold's training sum is the others'."""
    counts, known = _fitted(spark, sf_dir)
    sums = [F.sum(F.when(F.col("fold") == k, 1 + F.log("c"))).alias(f"a{k}") for k in range(5)]
    by_label = counts.join(_by_term(known), "term").groupBy("label", "term").agg(F.first("idf").alias("idf"), *sums)
    others = [sum((F.coalesce(f"a{j}", F.lit(0.0)) for j in range(5) if j != k), F.lit(0.0)) * F.col("idf")[k] for k in range(5)]
    others = [F.when(o > 0, o) for o in others]  # every document that has the term adds 1 at least
    m = by_label.select("label", "term", F.round(sum((F.coalesce(o, F.lit(0.0)) for o in others), F.lit(0.0)) / 5, 9).alias("mean"), sum((o.isNotNull().cast("long") for o in others), F.lit(0)).alias("folds")).where("folds > 0")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("mean"), "term"))
    return m.select("label", "term", "mean", "folds", place.cast("long").alias("place")).where("place <= 30")


QUERIES = {"tfidf_features": tfidf_features, "tfidf_vocabulary": tfidf_vocabulary, "top_terms": top_terms}
