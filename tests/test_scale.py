"""Steps that must not grow faster than their tables: the same rows as the plain way, by plans or work that stay linear."""

import random

import pytest

from riskloom.functions.dialect import Spark
from riskloom.functions.evidence import Pages, Quotes
from riskloom.operators.evidence import worded
from riskloom.plans import models, reports
from riskloom.plans.registry import ORACLE, QUERIES


def test_quotes_meet_only_texts_with_their_run():
    """Every quote that is in a text meets it, cut anywhere, over pages and ellipses; texts without its words don't."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É*s", "|", "#x", "ß"]
    texts = ["<!-- page 1 -->\n" + " ".join(draw.choices(words, k=80)) + "\n<!-- page 2 -->\n" + " ".join(draw.choices(words, k=80)) for _ in range(30)]
    quotes = []
    for t in texts:
        body = t.replace("<!-- page 1 -->\n", "").replace("\n<!-- page 2 -->", "")
        for n in (1, 6, 12, 40, 90):
            a = draw.randrange(len(body) - n)
            quotes.append(body[a : a + n])
            quotes.append(body[a : a + n] + " [...] " + body[a + n + 20 : a + n + 60])
    quotes = [*enumerate(quotes + ["", "...", "… w1 w2 w3", "nowhere at all in them", "w1 nowhere"])]
    asked, tried = Quotes(quotes), 0
    for t in texts:
        pages = Pages(t)
        met = [*asked.met_by(pages.text)]
        tried += len(met)
        assert sorted(i for i, q in met if pages.page(q) is not None) == [i for i, q in quotes if pages.page(q) is not None]
    assert tried < len(texts) * len(quotes) / 2
    assert [*Quotes([(1, "one two three four five six")]).met_by("one two three five four six")] == []


def test_cosines_by_blocks_of_ids(spark, tmp_path):
    """Negative, distant, repeated and null ids, null parts and short vectors: as the SQL has it, joined by blocks of ids."""
    rows = [(i, [float(i % 7), 1.0, float(i % 3) - 1]) for i in (-41, -25, -20, -5, -1, 0, 1, 15, 19, 20, 21, 39, 40, 100, 1000)]
    rows += [(15, [1.0, 2.0]), (15, [0.5, None, 4.0]), (20, None), (21, []), (22, [None, None]), (23, [2.0]), (None, [1.0, 1.0])]
    spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = models.cosine_similarity(spark, str(tmp_path))
    spark.read.parquet(f"{tmp_path}/embeddings.parquet").createOrReplaceTempView("embeddings")
    want = spark.sql(models.SQL["cosine_similarity"](Spark))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "block" in got._jdf.queryExecution().optimizedPlan().toString()


def test_no_task_ranks_a_class_or_a_scope():
    """Folds, AUCs and curves add up within slices; the plain windows stay in the SQL that DuckDB runs."""
    whole = ("over (partition by rep, label order by md5", "rank() over (partition by model, scope, cls order by p)", "over (partition by model, cls order by p desc)", "over (partition by model, cls order by fp)")
    for name in ("fold_assignment", "auc_every_class", "classification_all_scopes", "model_comparison", "summary_all_metrics", "roc_curves"):
        text, plain = reports.SQL.get(name, models.SQL.get(name)), ORACLE[name]
        assert any(w in plain for w in whole) and not any(w in text(Spark) for w in whole)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_normalised_once(spark):
    """A filter on normalised words would normalise every page a second time."""
    plan = _plan(worded(spark.createDataFrame([(1, ["a b", "c"]), (2, []), (3, None)], "doc_id long, pages array<string>")))
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_replace" in x]


@pytest.mark.parametrize("name", ["tfidf_features", "tfidf_vocabulary", "top_terms", "nearest_centroid"])
def test_texts_are_read_once(spark, name):
    """Terms are counted into a table; the query's plan doesn't go back to the texts for each use of them."""
    assert "regexp_extract_all" not in _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_a_text_of_dates_is_put_together_once(spark):
    assert _plan(QUERIES["order_periods"](spark, "/root/testdata/sf0.001")).count("date_format") == 4


def test_observed_points_makes_documents_once(spark, tmp_path):
    """Lineitem is read once and no cell is shuffled; rows as by the SQL, also for repeated, negative and null keys."""
    for name in ("region", "nation", "part", "customer", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{tmp_path}/orders.parquet").where("o_orderkey < 400").localCheckpoint()
    odd = orders.where("o_orderkey < 60").selectExpr("* except (o_orderkey, o_orderstatus)", "case when o_orderkey < 40 then o_orderkey when o_orderkey < 55 then -o_orderkey end o_orderkey", "'F' o_orderstatus").select(orders.columns)
    orders.unionByName(odd).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    for name in ("region", "nation", "part", "customer", "orders", "lineitem"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(name)
    want = spark.sql(reports.SQL["observed_points"](Spark))
    got = spark.sql(f"with {reports.observed_points(Spark)}")
    assert got.schema.simpleString() == want.schema.simpleString()
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(got) == rows(want)
    plan = QUERIES["observed_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Relation [l_orderkey#") == 1
