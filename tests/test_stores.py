"""Sources, sinks, run control, by file round trips."""

import json
import sqlite3
import zipfile

import pytest

from riskloom.operators.runs import RunError, Runs, estimate, one_source, preferences_text, required, run_all
from riskloom.sources import files
from riskloom.sources.files import FACTORS


def test_scrape_log_and_archive(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text("\ufeffprogram,tender_code,tender_status,doc_title,outcome,file_path\nGINOP,G-1,,A,downloaded,C:\\x\\a.pdf\nTOP,T-1,open,\"B, c\",downloaded,/y/b.pdf\nTOP,T-2,,C,failed,/y/c.pdf\n", encoding="utf-8")
    got = {r["original_name"]: r for r in files.downloads(spark, str(log)).collect()}
    assert {k: (r["location"], r["programme"], r["tender_status"]) for k, r in got.items()} == {"A": ("raw_pdfs/a.pdf", "GINOP", None), "B, c": ("raw_pdfs/b.pdf", "TOP", "open")}
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("data/raw_pdfs/m.pdf", b"%PDF-1")
        z.writestr("other/n.pdf", b"no")
    got = files.archived(spark, str(tmp_path / "v.zip"), {"m.pdf": "M-1"}).collect()
    assert [(r["original_name"], r["location"], r["raw_call_code"], bytes(r["content"])) for r in got] == [("m.pdf", "v.zip:data/raw_pdfs/m.pdf", "M-1", b"%PDF-1")]
    with pytest.raises(files.InvalidInput, match="m.pdf"):
        files.archived(spark, str(tmp_path / "v.zip"), {})


def test_pdfs_and_provenance(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "p/b.pdf").write_bytes(b"nothing")
    got = {r["name"]: r for r in files.pdfs(spark, str(tmp_path / "p")).collect()}
    assert got["a.pdf"]["is_pdf"] and not got["b.pdf"]["is_pdf"] and len(got["a.pdf"]["doc_id"]) == 16
    assert files.conflicts(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "name string, sha256 string")).collect()[0]["name"] == "a"
    db = sqlite3.connect(tmp_path / "old.db")
    db.execute("create table documents (file_hash, source_url, download_date)")
    db.executemany("insert into documents values (?, ?, ?)", [("h", "u1", "d1"), ("h", "u2", "d2"), ("k", None, None)])
    db.commit()
    db.close()
    assert sorted(map(tuple, files.provenance(spark, str(tmp_path / "old.db")).collect()), key=str) == [("h", "u2", "d2"), ("k", None, None)]


def test_gold_and_baseline(spark, tmp_path):
    path = tmp_path / "gold.csv"
    head = ";".join(["Felhívás", *FACTORS])
    path.write_text(f"\ufeff{head}\nA ;3;0;3;1;2;-;0;2;0;3\nB;1;0;0;1;2;3;0;0;3;0\n", encoding="utf-8")
    got = {(r["name"], r["factor"]): r["points"] for r in files.gold(spark, str(path)).collect()}
    assert len(got) == 20 and got["A", "eloleg"] is None and got["A", "tam_tevekenyseg"] == 2 and got["B", "biztositek"] == 0
    path.write_text(f"{head}\nA;0;0;1;1;2;x;0;1;0;3\nA;1;0;0;1;2;3;0;0;3;0\n", encoding="utf-8")
    with pytest.raises(files.InvalidInput) as e:
        files.gold(spark, str(path))
    assert all(x in str(e.value) for x in ("fin_form: '0'", "konzorcium: '1'", "eloleg: 'x'", "tam_tevekenyseg: '1'", "appears twice"))
    old = tmp_path / "old.csv"
    old.write_text("felhivas,factor,regex\nA,eloleg,3.0\nold B,idotartam,\n", encoding="utf-8")
    names = spark.createDataFrame([("A",), ("B",)], "name string")
    assert sorted(map(tuple, files.baseline(spark, str(old), names, {"old B": "B"}).collect())) == [("A", "eloleg", "found", 3), ("B", "idotartam", "not_found", None)]
    old.write_text("felhivas,factor,regex\nA,eloleg,1.5\nC,eloleg,1\nA,nothing,1\nA,idotartam,2\n", encoding="utf-8")
    with pytest.raises(files.InvalidInput) as e:
        files.baseline(spark, str(old), names, {})
    assert all(x in str(e.value) for x in ("not a call", "unknown factor", "not a number of points: 1.5"))
    assert files.baseline(spark, str(old), names, {}, strict=False).count() == 1


def test_settings_and_sinks(spark, tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"data_root": "data"}')
    assert files.settings(str(tmp_path / "c.json"))["data_root"] == str(tmp_path / "data")
    monkeypatch.setenv("RISKLOOM_DATA_ROOT", "/elsewhere")
    assert files.settings(str(tmp_path / "c.json"))["data_root"] == "/elsewhere"
    monkeypatch.delenv("RISKLOOM_DATA_ROOT")
    (tmp_path / "d.json").write_text("{}")
    with pytest.raises(files.InvalidInput):
        files.settings(str(tmp_path / "d.json"))
    (tmp_path / "i.json").write_text('{"doc_type_overrides": {"x": "poem"}}')
    with pytest.raises(files.InvalidInput, match="poem"):
        files.import_settings(str(tmp_path / "i.json"))
    out = files.write_json(spark, f"{tmp_path}/r.json", {"b": "é", "a": 1})
    assert (tmp_path / "r.json").read_text(encoding="utf-8") == '{\n  "a": 1,\n  "b": "é"\n}\n'
    with pytest.raises(FileExistsError):
        files.write_json(spark, out, {})
    files.remove(spark, out)
    assert not (tmp_path / "r.json").exists()
    files.write_csv(spark.createDataFrame([(1, "x;y")], "a int, b string"), f"{tmp_path}/t", ";")
    assert [tuple(r) for r in files.csv(spark, f"{tmp_path}/t", ";").collect()] == [("1", "x;y")]
    made = []
    make = lambda todo: (made.append(todo.count()), todo.selectExpr("k", "k * 2 v"))[1]
    for keys, want in (([1, 2], 2), ([2, 3], 1), ([3], 0)):
        rows = files.cached(spark.createDataFrame([(k,) for k in keys], "k int"), f"{tmp_path}/cache", ["k"], make)
        assert sorted(map(tuple, rows.collect())) == [(k, 2 * k) for k in keys] and made[-1] == want
    for keys in ([1, 2], [1, 2, 3]):
        assert files.logged(spark.createDataFrame([(k,) for k in keys], "k long"), f"{tmp_path}/log", ["k"], make).count() == len(keys)
    assert files.markdown_table(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")) == "| n | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    assert "runs ||--o{ facts : has" in files.er_diagram({"runs": [("id", "string")]}, [("facts", "runs")]) and "C1 --> C2" in files.data_flow([("C1", "C2")])
    assert "<\\/script>" in files.dashboard("t", {"x": "</script>"})


def test_runs(spark, tmp_path):
    runs = Runs(spark, f"{tmp_path}/runs", "v1")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, x string")
    with runs.stage("C1", {"b": 1, "a": "é"}) as c1:
        runs.publish(c1, "documents", rows, ["doc_id"])
    state = runs.get(c1)
    assert state["status"] == "complete" and state["config_json"] == '{"a": "é", "b": 1}' and len(state["config_hash"]) == 64
    with pytest.raises(ZeroDivisionError), runs.stage("C2", {}, [c1]) as c2:
        raise ZeroDivisionError("no")
    assert runs.get(c2)["status"] == "failed" and runs.get(c2)["error"] == "ZeroDivisionError: no" and runs.inputs(c2) == [c1]
    Runs(spark, f"{tmp_path}/runs", "v2").resume(c2, "C2")
    assert runs.get(c2)["status"] == "resumed" and runs.get(c2)["error"] is None and runs.code_versions(c2) == ["v1", "v2"]
    for bad in ((c1, "C2"), (c2, "C2"), ("nothing", "C1")):
        with pytest.raises(RunError):
            runs.require_complete(*bad)
    runs.require_complete(c1, "C1")
    with pytest.raises(RunError):
        runs.resume(c1, "C1")
    with pytest.raises(RunError, match="several rows"):
        runs.publish(c2, "documents", rows.unionAll(rows), ["doc_id"])
    runs.publish(c2, "documents", rows.selectExpr("doc_id + 1 doc_id", "x", "1 more"))
    runs.complete(c2)
    assert runs.read("documents", c1).count() == 2 and runs.read("documents").where("more is null").count() == 2
    assert runs.newest_with("documents", "doc_id", spark.createDataFrame([(3,)], "doc_id long")) == c2
    assert runs.newest_with("documents", "doc_id", spark.createDataFrame([(9,)], "doc_id long")) is None
    l1 = runs.start("L1", {}, [c2])
    assert runs.input_of(l1, "C1") == c1
    with pytest.raises(RunError, match="0 M1 runs"):
        runs.input_of(l1, "M1")
    assert set(runs.catalogue()) == {"documents", "events", "inputs"} and ("more", "int") in runs.catalogue()["documents"]
    with pytest.raises(RunError):
        runs.start("Z9", {})


def test_whole_chain_prefers_what_validation_suggests(spark, tmp_path):
    seen = []
    bodies = {"L2": lambda run, done, config: seen.append((config.get("preferences"), sorted(done))), "E1": lambda *a: {"eloleg": "llm"}}
    done = run_all(Runs(spark, f"{tmp_path}/r", "v"), bodies, {}, ("L1", "L2", "E1", "L2"))
    assert seen == [(None, ["L1"]), ({"eloleg": "llm"}, ["E1", "L1", "L2"])] and set(done) == {"L1", "L2", "E1"}


def test_small_helpers(spark):
    obs = spark.createDataFrame([("regex",), ("regex",)], "source string")
    assert one_source(obs) == "regex"
    for rows in ([("regex",), ("llm",)], [("manual",)]):
        with pytest.raises(RunError):
            one_source(spark.createDataFrame(rows, "source string"))
    assert "    eloleg: llm\n" in preferences_text({"eloleg": "llm"}, "E1-x")
    assert estimate(spark.createDataFrame([("abcdefgh",), ("a",)], "text string"), 4, 10, 1, 5, batch=True) == (2, 3, 20, (3 + 100) / 1e6 / 2)
    required(obs.limit(0), "none", ["source"])
    with pytest.raises(RunError, match="regex"):
        required(obs, "too many", ["source"])
