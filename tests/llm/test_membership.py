"""The membership filter loses no member and lets few others pass."""

from riskloom.llm.membership import possibly_in
from riskloom.llm.neardedup import dedup


def test_members_pass(spark):
    rows = spark.createDataFrame([(i if i % 50 else None, f"t{i}") for i in range(500)], "id long, t string")
    members = rows.where("t like '%7' or id is null").withColumnsRenamed({"id": "mid", "t": "mt"})
    got = {r.t for r in possibly_in(rows, ["id", "t"], members, ["mid", "mt"], words=64).collect()}
    assert {r.mt for r in members.collect()} <= got and len(got) < 120
    assert possibly_in(rows, ["id", "t"], members.limit(0), ["mid", "mt"], words=64).count() == 0
    full = {r.t for r in possibly_in(rows, ["id", "t"], rows.withColumnsRenamed({"id": "mid", "t": "mt"}), ["mid", "mt"], words=1).collect()}
    assert len(full) == 500


def test_near_copies_of_repeated_rows_and_null_ids(spark):
    words = [f"w{i * i % 997}" for i in range(400)]
    near, other = [*words[:200], "changed", *words[201:]], [f"v{i * i % 991}" for i in range(400)]
    rows = [(5, " ".join(words)), (5, " ".join(words)), (9, " ".join(near)), (None, " ".join(words)), (3, " ".join(other)), (8, None), (7, "")]
    kept = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [3, 5, 7]
