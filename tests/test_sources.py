import json

import pytest
from pyspark.sql import functions as F

from fitloom.functions import jsontext
from fitloom.plans import offline
from fitloom.sources import history, postings, store, taxonomy, uploads
from fitloom.sources.tables import read_table


def test_csv_inputs(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        'category,job_title,description,requirements_text,technical_skills\n'
        'it,dev,"two\nlines, ""quoted""",,"[\'Go\', \'SQL\']"\nit,dev, ,,x\nit,,text,,\nit,dev,,need this,\n'
        'it,dev, ,needs text,\n')
    (tmp_path / "r.csv").write_text("resume_text,job_text,ai_match_score\na,b,100\na,b,100.5\na,,50\na,b,zero\nc,d,0\n")
    tables = postings.load_all(spark, str(tmp_path / "p.csv"), str(tmp_path / "r.csv"))
    rows = tables["postings"].collect()
    assert sorted(r.description for r in rows) == [" ", 'two\nlines, "quoted"']
    assert sorted(r.ai_match_score for r in tables["pairs"].collect()) == [0.0, 100.0]
    assert spark.table("postings").count() == 2


def test_profiles_are_built_stored_and_kept(spark, tmp_path):
    rows = [(i, "Web Dev" if i % 3 else "Ops", "dev", f"- build pages with Docker and SQL number {i % 4} every day",
             "", "['SQL', 'rest api']") for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, category string, job_title string, description string, "
                                     "requirements_text string, technical_skills string")
    records = offline.build_profiles(postings.valid_postings(df), merge_variants=True)
    path = f"{tmp_path}/kb"
    store.write_profiles(records, path)
    got = {r.key: r for r in store.read_profiles(spark, path).collect()}
    assert set(got) == {"web_dev", "ops"}
    assert {e["item"] for e in got["ops"].core_skills} | {e["item"] for e in got["ops"].optional_skills} == {
        "SQL", "REST API", "Docker"}
    assert got["ops"].meta.jd_count == 4 and len(got["ops"].embedding) == 256
    other = records.withColumn("occupation", F.lit("changed"))
    store.write_profiles(other.filter("key = 'ops'"), path, overwrite=False)
    assert store.read_profiles(spark, path).filter("occupation = 'changed'").count() == 0
    store.snapshot(store.read_profiles(spark, path), f"{tmp_path}/copy")
    store.snapshot(other, f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").filter("occupation = 'changed'").count() == 0
    fresh = offline.reembed(store.read_profiles(spark, path))
    assert [r.embedding for r in fresh.orderBy("key").collect()] == [got[k].embedding for k in sorted(got)]
    store.write_json(store.read_profiles(spark, path), f"{tmp_path}/json")
    back = {r.key: r for r in store.read_json(spark, f"{tmp_path}/json", multi_line=False).collect()}
    assert [tuple(e) for e in back["ops"].core_skills] == [tuple(e) for e in got["ops"].core_skills]
    with pytest.raises(FileNotFoundError):
        store.read_profiles(spark, f"{tmp_path}/missing").count()


def test_json_profiles(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({
        "occupation": "a_b", "core_skills": {"x": 0.4, "y": 0.9}, "optional_skills": {},
        "responsibilities": ["r"], "embedding": [0.5, 0.5], "_parent": "p", "_meta": {"jd_count": 3}}, indent=2))
    (tmp_path / "bad.json").write_text("{ not json")
    rows = store.read_json(spark, str(tmp_path)).collect()
    assert [(r.key, r.parent, r.jd_count) for r in rows] == [("good", "p", 3)]
    assert [e["item"] for e in rows[0].core_skills] == ["y", "x"]
    kept = store.embeddings(store.read_json(spark, str(tmp_path)))
    assert kept.count() == 1


def test_gate_checks_in_order(spark):
    rows = [("a.pdf", 0, "x", "k"), ("a.pdf", 10 * 2**20 + 1, "x", "?"), ("a.txt", 5, "x", "?"), ("a.txt", 5, "", "k"),
            ("b.tar.PDF", 5, " \n", "k"), ("c.Docx", 5, "text", "k"), (".pdf", 5, "x", "k"), ("d", 5, "x", "k")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, filename string, n_bytes long, body string, target_key string")
    groups = spark.createDataFrame([("k",), ("k",)], "key string")
    out = uploads.ingest_gate(df, groups).orderBy("i").collect()
    assert [r.status for r in out] == [400, 413, 404, 415, 422, 200, 415, 415]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "key int, display string, core_skill_count int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "key int, display string, core_skill_count int")
    assert sorted(map(tuple, history.upsert(old, new).collect())) == [(1, "a", 1), (2, None, 5), (3, "c", 3)]


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"parent": "it", "key": "web", "display": "Web", "patterns": ["web"]}\n\n')
    rules = taxonomy.read_taxonomy(spark, str(tmp_path / "t.jsonl"))
    assert rules == [("it", "web", "Web", ["web"])]
    assert taxonomy.positions(spark, rules).collect()[0].sub == "web"


def test_sections(column):
    cases = ['{"experience": [" a ", "", 5, true, null], "projects": " p ", "education": {"x": 1}}', "[1]", "oops", None, "{}"]
    out = column(jsontext.json_sections, cases)
    assert (out[0].experience, out[0].projects, out[0].education) == (["a", "5", "True", "None"], ["p"], [])
    assert all(list(r) == [[], [], []] for r in out[1:])


def test_review(column):
    raw = json.dumps({
        "overall_assessment": ["x", 2], "strengths": " s ", "missing_skills": ["a", {"z": "first", "b": "", "a": 0, "c": "last"}, 4],
        "cv_quality": 7, "learning_roadmap": [{"giai_doan": "g", "focus": "f", "skills": "one"}, "later", 3, {"phase": ""}]})
    r = column(jsontext.normalize_review, [raw, "nope"])
    assert r[0].overall_assessment == "x 2" and r[0].strengths == [" s "] and r[0].cv_quality == []
    assert r[0].missing_skills == ["a", "first; last"]
    assert [tuple(s) for s in r[0].learning_roadmap] == [("g", "f", ["one"]), ("", "later", []), ("", "", [])]
    assert r[1].overall_assessment == "" and r[1].learning_roadmap == []


def test_prompt_lists(column):
    items = [["a", "b", "c"], [], ["a"]]
    assert column(lambda c: jsontext.inline_list(c, 2), items, "array<string>") == ["a, b … (+1)", "(không có)", "a"]
    assert column(lambda c: jsontext.bullet_list(c, 2), items, "array<string>") == ["  - a\n  - b", "  (không có)", "  - a"]


def test_tables_are_dealt_out_on_request(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    assert read_table(spark, f"{tmp_path}/t", 3).rdd.getNumPartitions() == 3
    assert read_table(spark, f"{tmp_path}/t").count() == 10


def test_a_store_can_be_rewritten_from_itself(spark, tmp_path):
    path = f"{tmp_path}/kb"
    store.write_profiles(spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int"), path)
    store.write_profiles(store.read_profiles(spark, path).withColumn("n", F.col("n") + 1), path)
    assert sorted(map(tuple, store.read_profiles(spark, path).collect())) == [("a", 2), ("b", 3)]
    broken = store.read_profiles(spark, path).withColumn("n", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        store.write_profiles(broken, path)
    assert sorted(map(tuple, store.read_profiles(spark, path).collect())) == [("a", 2), ("b", 3)]
    store.write_profiles(spark.createDataFrame([("b", 9), ("c", 4)], "key string, n int"), path, overwrite=False)
    assert sorted(map(tuple, store.read_profiles(spark, path).collect())) == [("a", 2), ("b", 3), ("c", 4)]


def test_equal_rows_have_ids_of_their_own(spark, tmp_path):
    (tmp_path / "r.csv").write_text("resume_text,job_text,ai_match_score\na,b,100\na,b,100\na,b,100\n")
    pairs = postings.load_pairs(spark, str(tmp_path / "r.csv"))
    assert pairs.count() == 3 == pairs.select("pair_id").distinct().count()


def test_cut_tables_are_removed(spark):
    import os

    from fitloom.plans import materialize
    kept = materialize.cut(spark.range(5))
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 5 and os.path.isdir(folder)
    materialize.clean(spark)
    assert not os.path.exists(folder)


def test_bad_rows_are_kept_aside(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        'category,job_title,description,requirements_text\n'
        'it,dev,"two\nlines, ""quoted""",x\nit,dev\nit,dev,text,more,and more\nit,dev,one, two,x\n,dev,text,\nit,dev, ,\nit,dev,,need\nit,dev,fine,\n')
    found = postings.check_postings(spark, f"{tmp_path}/p.csv")
    assert sorted(r.description for r in found.kept.collect()) == ["fine", 'two\nlines, "quoted"']
    assert found.kept.columns == ["category", "job_title", "description", "requirements_text", "row_id"]
    bad = {r.record: r.reason for r in found.rejected.collect()}
    assert {r for r in bad.values()} == {"columns", "no category", "no description", "blank"}
    assert {k.strip() for k, r in bad.items() if r == "columns"} == {"it,dev", "it,dev,text,more,and more", "it,dev,one, two,x"}
    assert json.loads(next(k for k, r in bad.items() if r == "no category")) == {"job_title": "dev", "description": "text"}
    assert found.counts == {"read": 8, "rejected": 6, "columns": 3, "no category": 1, "no description": 1, "blank": 1}
    assert found.counts["read"] == found.kept.count() + found.rejected.count()
    (tmp_path / "r.csv").write_text("a,b,100\na,b,100.5\na,,50\na,b,zero\n\"open,b,3\n")
    pairs = postings.check_pairs(spark, f"{tmp_path}/r.csv", columns=["resume_text", "job_text", "ai_match_score"])
    assert [(r.resume_text, r.ai_match_score) for r in pairs.kept.collect()] == [("a", 100.0)]
    assert sorted(r.reason for r in pairs.rejected.collect()) == ["columns", "no job_text", "score is no number", "score out of range"]
    assert len({r.pair_id for r in pairs.rejected.collect()}) == 4


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "p.csv").write_text("category,job_title,description\n")
    found = postings.check_postings(spark, f"{tmp_path}/p.csv")
    assert found.kept.count() == found.rejected.count() == 0 and found.counts == {"read": 0, "rejected": 0}


def test_oversized_files_are_not_opened(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for name, body in (("a.pdf", b"text"), ("b.pdf", b"x" * 3000), ("c.docx", b""), ("d.pdf", b"\xff\xfe"), ("e.txt", b"text"), ("deep/f.PDF", "é".encode())):
        (folder / name).write_bytes(body)
    files = uploads.read_uploads(spark, str(folder), 1000)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # reading a larger file is an error
    try:
        groups = spark.createDataFrame([("k",)], "key string")
        out = {r.filename: r for r in uploads.ingest_gate(files.withColumn("target_key", F.lit("k")), groups, max_bytes=1000).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {k: r.status for k, r in out.items()} == {"a.pdf": 200, "b.pdf": 413, "c.docx": 400, "d.pdf": 422, "e.txt": 415, "f.PDF": 200}
    assert out["b.pdf"].body is None and out["b.pdf"].n_bytes == 3000 and out["f.PDF"].section_text == "é"


@pytest.mark.parametrize("mounted", [True, False])
def test_uploads_share_folders_and_keep_their_names(spark, tmp_path, mounted):
    """Files lie together, a few folders for many; names and texts stay with each other, empty and odd ones too."""
    rows = [(f"ü {k} 50%+a/b.pdf", f"text {k}\nzwei" if k % 5 else "" if k % 2 else None) for k in range(60)] + [("same.pdf", "one"), ("same.pdf", "two")]
    named = spark.createDataFrame(rows, "name string, value string").repartition(3)
    folder = tmp_path / "in"
    names = uploads.write_uploads(named, str(folder), per_folder=5, mounted=mounted)
    folders = {p.parent for p in folder.rglob("part-*")}
    assert len(folders) <= 13 and len(list(folder.rglob("part-*"))) == len(rows)
    found = uploads.read_uploads(spark, str(folder), 8, names=names).collect()
    want = sorted((n, len(body.encode()), body if len(body) <= 8 else None) for n, body in ((n, (v or "") + "\n") for n, v in rows))
    assert sorted((r.filename, r.n_bytes, r.body) for r in found) == want
    assert uploads.write_uploads(named.limit(0), f"{tmp_path}/none", mounted=mounted).count() == 0
    assert uploads._local_path(spark, f"file://{folder}") == uploads._local_path(spark, str(folder)) == str(folder)


def test_each_file_is_looked_at_by_one_scan(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"a+b c%41 {k}.pdf").write_bytes(b"x" * (k % 4) * 10)
    files = uploads.read_uploads(spark, str(tmp_path), 20)
    assert sorted((r.filename, r.n_bytes, r.body) for r in files.collect()) == sorted(
        (f"a+b c%41 {k}.pdf", k % 4 * 10, None if k % 4 in (0, 3) else "x" * (k % 4) * 10) for k in range(40))
    assert files.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    # bodies meet no join, so they are not shuffled
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Join LeftAnti" in plan


def test_written_uploads_are_listed_by_tasks(spark, tmp_path):
    """On a mounted disk no listing of all files reaches the driver; both readers find the same."""
    folder = tmp_path / "in"
    named = spark.createDataFrame([(f"f{k}.pdf", "x" * (k % 30)) for k in range(90)], "name string, value string")
    names = uploads.write_uploads(named, str(folder), per_folder=7)
    (folder / "bucket=0" / "_left").write_bytes(b"part of a file")
    (folder / "bucket=0" / "empty.pdf").write_bytes(b"")
    (folder / "_draft").mkdir()
    (folder / "_draft" / "part-c000.txt").write_bytes(b"draft")
    found = uploads.read_uploads(spark, str(folder), 20, names=names)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "LeftAnti" not in plan
    rows = sorted(map(tuple, found.collect()), key=str)
    assert rows == sorted(map(tuple, uploads.read_uploads(spark, str(folder), 20, names=names, mounted=False).collect()), key=str)
    assert len(rows) == 91 and sum(r[3] is None for r in rows) == 1 + sum(k % 30 > 19 for k in range(90))
