"""Quotes held against a paged text: normalised, across page breaks, shortened by ellipses."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

# The page marker, what stands for left-out words, least length of a piece, most an ellipsis skips, words of a run.
PAGE_MARKER = re.compile(r"<!-- page (\d+) -->")
ELLIPSIS = re.compile(r"\s*[\[(]?\s*(?:\.\.\.|…)\s*[\])]?\s*")
LEAST_PIECE, MOST_SKIPPED, RUN = 20, 300, 3

_MARKUP = str.maketrans({"*": None, "_": None, "`": None, "|": " ", "#": " "})


def normalised(text: str) -> str:
    """Without emphasis, table pipes and headings as blanks, one blank between words, case folded."""
    return " ".join(text.translate(_MARKUP).split()).casefold()


class Pages:
    """A Markdown text's pages as one normalised string that knows where each page starts."""

    def __init__(self, markdown: str):
        marks = [*PAGE_MARKER.finditer(markdown)]
        bodies = [normalised(markdown[a.end() : b]) for a, b in zip(marks, [*(m.start() for m in marks[1:]), len(markdown)])]
        self.numbers = [int(m[1]) for m in marks]
        self.starts = [0]
        for body in bodies[:-1]:
            self.starts.append(self.starts[-1] + len(body) + 1)
        self.text = " ".join(bodies)

    def place(self, quote: str) -> int | None:
        """Where the quote starts: as it is, or in pieces that follow each other closely enough."""
        whole = normalised(quote)
        if not whole or not self.numbers:
            return None
        if (at := self.text.find(whole)) >= 0:
            return at
        pieces = [p for p in map(normalised, ELLIPSIS.split(quote)) if p]
        if len(pieces) < 2 or min(map(len, pieces)) < LEAST_PIECE:
            return None
        follow = "".join(f"(?>.{{0,{MOST_SKIPPED + 1}}}?{re.escape(p)})" for p in pieces[1:])  # each the nearest, without a second try
        found = re.search(re.escape(pieces[0]) + follow, self.text, re.S)
        return found.start() if found else None

    def page(self, quote: str) -> int | None:
        at = self.place(quote)
        return None if at is None else self.numbers[bisect_right(self.starts, at) - 1]


class Quotes:
    """Quotes by a run of inner words of their first piece: whatever text holds a quote has these as whole words in a row,
    so a text meets only quotes whose run it has. Quotes of two words or fewer have none and meet every text."""

    def __init__(self, quotes: list[tuple[int, str]]):
        self.runs: dict[int, dict[tuple, list]] = {}
        self.others = []
        for item, quote in quotes:
            pieces = [p for p in map(normalised, ELLIPSIS.split(quote)) if p]
            inner = (pieces[0] if len(pieces) > 1 else normalised(quote)).split(" ")[1:-1]
            if not inner:
                self.others.append((item, quote))
                continue
            n = min(RUN, len(inner))
            run = max(zip(*(inner[i:] for i in range(n))), key=lambda r: sum(map(len, r)))
            self.runs.setdefault(n, {}).setdefault(run, []).append((item, quote))

    def met_by(self, text: str):
        """(item, quote) of all that a normalised text may hold."""
        words = text.split(" ")
        for n, runs in self.runs.items():
            for run in runs.keys() & set(zip(*(words[i:] for i in range(n)))):
                yield from runs[run]
        yield from self.others


FOUND = "doc_id long, item_id long, page int"


def found_in(documents: DataFrame, quotes: DataFrame, block: int = 2000) -> DataFrame:
    """(doc_id, item_id, page) of every quote (item_id, text) in every paged text (doc_id, markdown).

    Quotes are held in blocks of a bounded number; a text is passed once for each block, and held against those
    quotes alone whose run of words it has."""
    spark, out, held = documents.sparkSession, None, []

    def search(part):
        asked = Quotes(part)

        def run(batches):
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("markdown").to_pylist()):
                    pages = Pages(text or "")
                    rows += [(doc, item, page) for item, quote in asked.met_by(pages.text) if (page := pages.page(quote)) is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "page"])

        return documents.select("doc_id", "markdown").mapInArrow(run, FOUND)

    for r in quotes.where("text is not null").select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == block:
            out = search(held) if out is None else out.unionByName(search(held))
            held = []
    if held:
        out = search(held) if out is None else out.unionByName(search(held))
    return spark.createDataFrame([], FOUND) if out is None else out
