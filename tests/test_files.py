import json

from pyspark.sql import functions as F

from sheafline.sources import files


def test_manifest_round_trip(spark, tmp_path):
    m = {"manifest_id": "m", "created_at": "2024-01-01T00:00:00Z", "revision": 1, "status": "extracted", "title": "t", "elements": [{"id": "e1", "type": "title", "reading_order": 1}], "obligations": []}
    (tmp_path / "m.json").write_text(json.dumps(m, indent=2))
    r = files.manifests(spark, str(tmp_path / "m.json")).first()
    assert r.elements[0].type == "title" and r.revision == 1
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, run string")
    files.write_json(df, str(tmp_path / "out"), "run")
    files.write_json(df, str(tmp_path / "out"), "run")
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_admission(spark, tmp_path):
    for n in ("a.PDF", "b.exe", "c.html", "d"):
        (tmp_path / n).write_bytes(b"x")
    f = files.admitted(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.admitted for r in f.collect()} == {"a.PDF": True, "b.exe": False, "c.html": True, "d": False}
    assert files.extract(f).count() == 2


def test_plan_text(spark):
    df = spark.createDataFrame([(" (start-processing)",), ("(execute-obligation o1 m2)",), ("; cost = 3",), ("noise",)], "x string")
    got = [r[0] for r in df.select(files.plan_steps(F.col("x"))).collect()]
    assert got[0].action == "start-processing" and got[0].first is None
    assert (got[1].first, got[1].second) == ("o1", "m2") and got[2] is None and got[3] is None


def test_domain(spark, tmp_path):
    (tmp_path / "d.pddl").write_text("; version: 2.2\n(define (domain docs)\n (:action x))")
    r = files.domain_bundle(spark, str(tmp_path)).first()
    assert (r.name, r.version, r.has_actions) == ("docs", "2.2", True)


def test_updates(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "task_id string, n int, s string")
    got = files.update_by_key(rows, spark.createDataFrame([("b", 9)], "task_id string, n int"), "task_id")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x"), ("b", 9, "y")]
    new = spark.createDataFrame([("b", 5, "z"), ("c", 3, "q"), ("c", 1, "w")], "task_id string, n int, s string")
    assert [tuple(r) for r in files.insert_or_ignore(rows, new, "task_id").collect()] == [("c", 1, "w")]
