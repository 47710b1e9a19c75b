"""Terms of each class from fitted models."""

from __future__ import annotations

from riskloom.functions.dialect import Spark
from riskloom.operators.terms import fitted_top_terms as fitted
from riskloom.plans.features import words
from riskloom.plans.models import folds
from riskloom.sources.tables import table, views


def fitted_top_terms(spark, sf_dir):
    """Thirty terms a class by their mean weight over the five folds of the first repeat; every labelled document counts."""
    views(spark, sf_dir)
    own = spark.sql(f"with {folds(Spark)} select doc_id, label, rep, fold split from folds where rep = 0")
    return fitted(table(spark, sf_dir, "documents"), words(), own)


QUERIES = {"fitted_top_terms": fitted_top_terms}
