import json

import pytest
from pyspark.sql import functions as F

from quaestor.functions import sampling
from quaestor.operators import datasets, evaluate, generate, judge, pages, runs
from quaestor.sources import files, prompts, schemas
from quaestor.streaming import scores


def test_json_documents(spark, tmp_path):
    pairs = [{"question": "q", "right_answer": "a", "hallucinated_answer": "b"}] * 2
    (tmp_path / "report1_qch.json").write_text(json.dumps(pairs, indent=4))
    (tmp_path / "report2_qch.json").write_text("null")
    (tmp_path / "report3_qch.json").write_text(json.dumps(pairs[0]))
    (tmp_path / "report4_qch.json").write_text("")
    got = files.json_documents(spark, str(tmp_path), schemas.QCH).collect()
    assert sorted(r.file for r in got) == ["report1_qch.json"] * 2 + ["report3_qch.json"] and got[0].question == "q"
    assert files.json_arrays(spark, str(tmp_path / "report1_qch.json"), schemas.QCH).count() == 2


def test_csv_and_dictionary(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Question,Correct Answers\n"a ""b"",\nc",x; y\n')
    assert files.qa_file(spark, str(tmp_path / "a.csv")).first().Question == 'a "b",\nc'
    (tmp_path / "dx.csv").write_text("DIAGNOSIS CODE,LONG DESCRIPTION\n0010,First\n250,Old\n250,New\n")
    assert {r.code: r.description for r in files.code_dictionary(spark, str(tmp_path / "dx.csv")).collect()} == {"0010": "First", "250": "New"}


def test_xml(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "report1.xml").write_text("<any><chief_complaint> Pain </chief_complaint><admit_diagnosis>25.0</admit_diagnosis><discharge_diagnosis>250, ,9.9</discharge_diagnosis><report_text>Some TEXT _ tail</report_text></any>")
    dictionary = spark.createDataFrame([("250", "Sugar")], "code string, description string")
    got = files.clean_reports(files.clinical_xml(spark, str(tmp_path / "r")), dictionary).first()
    assert (got.chief_complaint, got.admit_diagnosis, got.discharge_diagnosis, got.report_text) == ("pain", "sugar", ["sugar", "unknown diagnosis code"], "some text")
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.xml").write_text('<Document url="http://u"><QAPairs><QAPair pid="1"><Question qid="x">Q &amp; 1</Question><Answer>A1</Answer></QAPair><QAPair><Question>Q2</Question></QAPair></QAPairs></Document>')
    (tmp_path / "q" / "2.xml").write_text('<doc url="http://v"><qaPairs><pair><question>q3</question><answer>a3</answer></pair></qaPairs></doc>')
    rows = files.question_xml(spark, str(tmp_path / "q")).orderBy("url", "pair").collect()
    assert [(r.url, r.question, r.answer) for r in rows] == [("http://u", "Q & 1", "A1"), ("http://u", "Q2", None), ("http://v", "q3", "a3")]


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("=== x\nFinished after 3700.5 seconds\n")
    (tmp_path / "b.log").write_text("x\nFinished after 20 seconds")
    (tmp_path / "c.log").write_text("=== x\nstopped\n")
    (tmp_path / "d.log").write_text("")
    got = runs.total_time(files.whole_files(spark, str(tmp_path), ".log")).first()
    assert (got.runs, got.seconds, got.duration) == (2, 3720.5, "1 hours and 2 minutes")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    files.write_table(rows, str(tmp_path / "t"), ["id"])
    files.write_json(rows, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert sorted(json.loads(r.value)["id"] for r in files.lines(spark, str(tmp_path / "j")).collect()) == [1, 2]
    good, bad = files.split_rejects(rows, F.col("t") == "a")
    assert (good.count(), bad.count()) == (1, 1)


HTML = "<body><div class='page-info x'>i</div><div>gone</div><article><p>One <a>link</a> two</p><script>s()</script><p>Last Revised - 1</p></article></body>"


def test_page_rules(spark):
    rule = next(r for r in pages.RULES if r.name == "H6")
    assert pages.page_content(HTML, rule) == "One\nlink\ntwo\n"
    assert "s()" in pages.page_content(HTML, rule, scripts=True)
    assert pages.page_content("<p>x</p>", rule) is None and pages.page_content(None, rule) is None
    third = next(r for r in pages.RULES if r.name == "H3")
    page = "<div><p><b>On this page:</b></p><ul><li>x</ul><article class='a dk-content'>Text<h2>References</h2>r</article></div>"
    assert pages.page_content(page, third) == "Text\n"
    rows = spark.createDataFrame([(1, "https://www.nlm.nih.gov/medlineplus/druginfo/meds/a.html", HTML), (2, "http://unknown/x", HTML), (3, "https://www.nlm.nih.gov/medlineplus/druginfo/meds/a.html", HTML)], "id int, url string, html string")
    got = {r.id: r.content for r in pages.with_contents(rows.select("id", "url"), rows, "url").collect()}
    assert got[1] == got[3] == "One\nlink\ntwo\n" and got[2] is None


def test_judge(spark, tmp_path):
    class Failing:
        def ask(self, turns, salt, timeout):
            raise TimeoutError("late")

    rows = spark.createDataFrame([(k, 0, ["q", "a"]) for k in range(20)], "qa_id long, trial int, turns array<string>")
    path = str(tmp_path / "responses")
    failed = judge.ask_missing(rows.limit(5), path, Failing())
    assert failed.filter("response IS NULL AND error LIKE 'TimeoutError%'").count() == 10
    first = judge.last_turn(judge.ask_missing(rows, path, judge.HashJudge()))
    again = judge.last_turn(judge.ask_missing(rows, path, Failing()))
    assert first.count() == 20 and first.filter("response IS NULL").isEmpty() and sorted(first.collect()) == sorted(again.collect())
    tried = spark.createDataFrame([(1, 0, 1, None, "late"), (1, 0, 1, "yes", None), (1, 0, 0, "x", None), (2, 0, 1, None, "late")], judge.SCHEMA)
    for order in (F.asc("error"), F.desc("error")):
        assert {r.qa_id: r.response for r in judge.last_turn(tried.orderBy(order)).collect()} == {1: "yes", 2: None}

    class Slow:
        def ask(self, turns, salt, timeout):
            import time

            time.sleep(20 if salt.startswith("1|") else 0)
            return turns

    slow = judge.ask_all(rows.filter("qa_id < 3").coalesce(1), Slow(), timeout=0.5).collect()
    assert {r.qa_id for r in slow if r.error} == {1} and {r.response for r in slow if not r.error} == {"q", "a"}


def test_scores_that_are_missing_do_not_count(spark):
    rows = spark.createDataFrame([("r", 0.9, 1), ("r", 0.1, 0), ("r", None, 1), ("r", float("nan"), 1), ("r", 0.5, None)], "run string, s double, y int")
    curve = evaluate.roc_curve(rows, "run", "s", "y")
    assert sorted((r.threshold, r.tp, r.fp) for r in curve.collect()) == [(0.1, 1, 1), (0.9, 1, 0), (float("inf"), 0, 0)]
    counts = evaluate.confusion(rows, "run", "s", "y", evaluate.optimal_threshold(curve)).first()
    assert (counts.threshold, counts.tp, counts.tn, counts.fp, counts.fn) == (0.9, 1, 1, 0, 0)


def test_missing_and_empty_answers(spark):
    rows = spark.createDataFrame([("q", None), ("q", ""), ("q (are)", "a"), (None, "a"), ("q", "No information found.")], "q string, a string")
    assert sorted(tuple(r) for r in datasets.good_pairs(rows, "q", "a").collect()) == [("q", ""), ("q", "a")]


def test_generation(spark, tmp_path):
    with pytest.raises(ValueError, match="nope"):
        generate.check_model("nope", ["a", "b"])
    with pytest.raises(Exception, match="no such model"):
        generate.checked_models(spark.createDataFrame([("nope",)], "m string"), "m", ["a"]).collect()
    rows = spark.createDataFrame([(1, "c", "q", "a"), (2, "c", "q2", "b")], "id long, context string, question string, right_answer string")
    asked = generate.stage_prompts(rows, "id", "[C] [Q]\n[next]\n[A]", [("[C]", F.col("context")), ("[Q]", F.col("question")), ("[A]", F.col("right_answer"))])
    assert sorted((r.qa_id, r.turns) for r in asked.collect()) == [(1, ["c q", "a"]), (2, ["c q2", "b"])]
    responses = judge.ask_missing(asked, str(tmp_path / "r"), judge.HashJudge())
    assert generate.regenerated(rows, responses, "id").filter("right_answer LIKE '%erdict%'").count() == 2
    strict = spark.createDataFrame([(1, 0, 0, "One. It may hallucinate. The context! Two.", None)], judge.SCHEMA)
    got = {r.id: r.hallucinated_answer for r in generate.hallucinated(rows, strict, "id", strict=True).collect()}
    assert got == {1: "One. Two.", 2: None}
    listed = spark.createDataFrame([(1, 'x [{"question":"q","right_answer":["a","b"],"hallucinated_answer":"h"}]'), (2, '[{"question":"q"}]'), (3, None)], "id long, r string")
    docs = generate.documents_of_pairs(listed, "id", "r")
    assert {r.id: r.ok for r in docs.collect()} == {1: True, 2: False, 3: False}
    assert [tuple(r) for r in generate.pairs(docs, "id").collect()] == [(1, 0, "q", "a; b", "h")]
    few = spark.createDataFrame([("s", "f1", 1), ("s", "f1", 2), ("t", "f2", 3), ("t", "f3", 4)], "s string, f string, id int")
    with pytest.raises(ValueError, match="s: fewer than 2"):
        sampling.stratified(few, "s", "f", "id", 2, "x", strict=True)
    assert sampling.stratified(few, "s", "f", "id", 1, "x", strict=True).count() == 2


def test_run_tables_and_arrays(spark, tmp_path):
    path, ticks = str(tmp_path / "runs"), iter([100.0, 3761.5, 200.0])
    runs.recorded_run(spark, path, "a", "Detect", {"model": "m", "limit": None}, lambda: 1, clock=lambda: next(ticks))
    with pytest.raises(ZeroDivisionError):
        runs.recorded_run(spark, path, "b", "Detect", {}, lambda: 1 // 0, clock=lambda: next(ticks))
    table = spark.read.schema(runs.RUNS).parquet(path)
    assert {r.run_id: (r.seconds, bool(r.error)) for r in table.collect()} == {"a": (3661.5, False), "b": (None, True)}
    logs = table.select(runs.log_text(F.col("title"), F.col("settings"), F.col("started"), F.col("seconds")).alias("content"))
    assert [tuple(r) for r in runs.total_time(logs).collect()] == [(1, 3661.5, "1 hours and 1 minutes")]
    runs.record_trials(spark.createDataFrame([(1, 0, 0, "x", None)], judge.SCHEMA), str(tmp_path / "trials"), "a")
    assert spark.read.schema(runs.TRIALS).parquet(str(tmp_path / "trials")).first().run_id == "a"
    rows = spark.range(7).select("id", F.when(F.col("id") > 2, F.concat(F.lit('a"\n'), "id")).alias("t"))
    for parts in (1, 3, 9):
        files.write_json_arrays(rows.repartition(parts), str(tmp_path / "j"))
        assert sorted((r.id, r.t) for r in files.json_arrays(spark, str(tmp_path / "j"), "id long, t string").collect()) == sorted((r.id, r.t) for r in rows.collect())
        assert all(len(json.loads(r.content)) >= 0 for r in files.whole_files(spark, str(tmp_path / "j")).collect())


def test_prompts(spark):
    rows = prompts.table(spark).collect()
    assert {r.role for r in rows} == {"agnostic", "medical"} and all("[" in r.body for r in rows)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "Verdict: Yes"), ("2024-01-01 00:02:00", "Verdict: No"), ("2024-01-01 01:00:00", "x")], "t string, response string").select(F.to_timestamp("t").alias("ts"), "response")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = scores.verdict_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.mean_verdict, r.n) for r in spark.table("rates").orderBy("start").collect()] == [(0.5, 2), (0.5, 1)]
