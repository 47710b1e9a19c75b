"""Page cleaning, evidence, windows and the ten rules on hand-made texts."""

from datetime import date

import pytest

from riskloom.functions import cleaning, evidence


def paged(*pages):
    return "".join(f"<!-- page {i} -->\n{p}\n\n" for i, p in enumerate(pages, 1))


def asked(question, answer):
    return f"|{question}|{answer}|\n|---|---|\n|Hol valósítható meg?|Magyarország|"


def test_characters_and_words():
    assert cleaning.characters("érték ﬁnanszírozás és­tá​mogatás") == "érték finanszírozás éstámogatás"
    for lines, want in ((["a támoga-", "tás összege"], ["a támogatás összege"]), (["a 2021-", "2027 évi"], ["a 2021-", "2027 évi"]), (["az EU-", "pénz"], ["az EU-", "pénz"]), (["kis-", "- és közép"], ["kis-", "- és közép"]), (["| a-", "b |"], ["| a-", "b |"]), ([], [])):
        assert cleaning.joined_words(lines) == want
    assert cleaning.tidy(["", "a   b", "", "", "c  ", ""]) == ["a b", "", "c"]
    assert cleaning.tidy(["| a  |  b | ", "x   y"]) == ["| a  |  b |", "x y"]
    assert cleaning.without_breaks("|a<BR/>b|\n<!-- image -->\nx<br>y") == "|a b|\nx<br>y"


def test_furniture_goes_and_bodies_stay():
    body = lambda i: [f"{c}{'xyzuv'[i]} sor" for c in "abcdefgh"]
    pages = [["Felhívás", *body(i), f"{i + 1}. oldal"] for i in range(5)]
    assert cleaning.without_furniture(pages) == [body(i) for i in range(5)]
    two = [["cím" if i < 2 else f"rész {'abcdefghij'[i]}", f"szöveg {'abcdefghij'[i]}"] for i in range(10)]
    assert cleaning.without_furniture(two)[0][0] == "cím"  # two of ten pages are too few
    assert cleaning.without_furniture([["12", "a", "b", "c", "d", "e", "- 13 -"]]) == [["a", "b", "c", "d", "e"]]
    table = [["| név |", "|---|", f"| {i} |", "szöveg"] for i in range(5)]
    assert all(p[0] == "| név |" for p in cleaning.without_furniture(table))


def test_assembling_and_warnings():
    assert cleaning.assemble(["első", "", "harmadik"]) == "<!-- page 1 -->\nelső\n\n<!-- page 2 -->\n\n<!-- page 3 -->\nharmadik\n"
    assert cleaning.tables("| a |\n|---|\n\n| c |\n| :--- |\n") == 2
    assert cleaning.warnings("õ", 2, 3, True) == ["low_text", "ocr_used", "page_count_mismatch", "suspect_encoding"]
    assert cleaning.warnings("x" * 8000, 2, 2) == []


def test_converted_rows(spark):
    got = {r["doc_id"]: r for r in cleaning.converted(spark.createDataFrame([(1, ["egy", None]), (2, []), (3, None)], "doc_id long, pages array<string>")).collect()}
    assert got[1]["markdown"] == "<!-- page 1 -->\negy\n\n<!-- page 2 -->\n" and got[1]["page_count"] == 2
    assert got[2]["status"] == got[3]["status"] == "failed"


def test_quotes():
    pages = evidence.Pages(paged("# Cím\nAz **első** oldal vége", "folytatás | a táblában |", "végül még egy hosszú mondat áll itt"))
    assert pages.page("az első OLDAL vége folytatás") == 1 and pages.page("a táblában") == 2 and pages.page("nincs") is None
    assert pages.page("folytatás a táblában végül … hosszú mondat áll itt") == 2
    assert pages.page("folytatás … áll itt") is None  # pieces too short
    assert evidence.Pages("no marker").page("marker") is None and pages.page("") is None
    far = evidence.Pages(paged("egy elég hosszú kezdet " + "x" * 400 + " és egy elég hosszú folytatás"))
    assert far.page("egy elég hosszú kezdet [...] és egy elég hosszú folytatás") is None  # skips too much


def test_quotes_in_documents(spark):
    docs = spark.createDataFrame([(1, paged("alma körte", "szilva")), (2, None)], "doc_id long, markdown string")
    quotes = spark.createDataFrame([(7, "szilva"), (8, "dió"), (9, None), (10, "ALMA")], "item_id long, text string")
    for block in (1, 100):
        assert sorted(map(tuple, evidence.found_in(docs, quotes, block).collect())) == [(1, 7, 2), (1, 10, 1)]
    assert evidence.found_in(docs, quotes.limit(0)).count() == 0
