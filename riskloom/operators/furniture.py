"""Page furniture: lines that stand at the top or bottom of many of a document's pages, and page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evidence import WHITE, kept, small

# Lines looked at on each edge of a page, share of the pages, page numbers.
EDGE, SHARE = 3, 0.3
PAGE_NUMBER = rf"^(?:[-–]?{WHITE}*\p{{Nd}}{{1,4}}{WHITE}*[-–]?|\p{{Nd}}{{1,4}}{WHITE}*/{WHITE}*\p{{Nd}}{{1,4}})$"
_ENDS = rf"^{WHITE}+|{WHITE}+$"


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, _ENDS, "")


def edges(lines: Column) -> Column:
    """(at, line) of the first and last EDGE lines, from 0, that aren't empty or of a table."""
    held = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), stripped(x).alias("line"))), lambda s: (s["line"] != "") & ~F.startswith(s["line"], F.lit("|")))
    return F.array_distinct(F.concat(F.slice(held, 1, EDGE), F.slice(F.reverse(held), 1, EDGE)))


def key(line: Column) -> Column:
    """What tells lines apart: digits count alike; the MD5 stands for the text, so that counts move little."""
    return F.md5(F.regexp_replace(line, r"\p{Nd}", "#"))


def furniture(pages: DataFrame) -> DataFrame:
    """doc and keys: edge-line keys of at least two pages and over SHARE of a document's, 6 / SHARE of them at most.

    pages: doc, edge. Counts are summed where the pages are before they move."""
    total = pages.groupBy(F.col("doc").alias("d")).agg(F.count(F.lit(1)).alias("pages"))
    counted = pages.select("doc", F.explode(F.array_distinct(F.transform("edge", lambda e: key(e["line"])))).alias("key")).groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    met = counted.join(total, F.col("doc").eqNullSafe(F.col("d"))).where(F.col("n") > SHARE * F.col("pages"))
    return met.groupBy("doc").agg(F.collect_set("key").alias("keys"))


def without_furniture(documents: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """doc_id, page, text, n_lines, n_removed: pages without furniture and page numbers on their edges.

    One row a page: an id, a page number, and the text. A null text is empty; a null id is a document of its own;
    repeated rows are pages of their own. Pages stay where they are unless over FEW documents have furniture."""
    pages = documents.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines")).withColumn("edge", edges(F.col("lines")))
    found = small(kept(furniture(pages).select(F.col("doc").alias("d"), "keys")))
    met = pages.join(found, F.col("doc").eqNullSafe(F.col("d")), "left")
    gone = F.transform(F.filter("edge", lambda e: F.coalesce(F.array_contains(F.col("keys"), key(e["line"])), F.lit(False)) | e["line"].rlike(PAGE_NUMBER)), lambda e: e["at"])
    left = F.filter("lines", lambda x, i: ~F.array_contains(F.col("gone"), i))
    n = F.size("lines").cast("long")
    return met.withColumn("gone", gone).select(F.col("doc").alias("doc_id"), "page", F.array_join(left, "\n").alias("text"), n.alias("n_lines"), (n - F.size(left)).alias("n_removed"))
