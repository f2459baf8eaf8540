import pytest
from pyspark.sql import functions as F

from quaestor.functions import sampling, text
from quaestor.operators import datasets


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "response, first, second",
    [
        ("#Verdict#:  Yes", 1.0, 0.0),
        ("#Verdict#: <Yes>", 1.0, 0.0),
        ("x\n#Verdict#: No", 0.0, 1.0),
        ("#Verdict#: No\n", 0.0, 0.5),
        ("**Verdict**: yes", 0.5, 0.5),
        ("Verdict: True", 1.0, 0.0),
        ("Verdict - Falsey", 0.0, 1.0),
        ("#Verdict#: None", 0.0, 1.0),
        ("", 0.5, 0.5),
        ("a #Verdict#: Yes\nbye", 0.5, 0.5),
    ],
)
def test_verdicts(spark, response, first, second):
    assert one(spark, response, text.verdict) == first
    assert one(spark, response, lambda c: text.verdict(c, supported=True, trim=False)) == second


def test_null_response_is_undecided(spark):
    assert one(spark, None, text.verdict) == 0.5


def test_samples_keep_spaces_and_repeats(spark):
    assert one(spark, "a; b;a", lambda c: text.without(F.split(c, ";"), F.lit("a"))) == [" b"]
    assert one(spark, "x;b;b", lambda c: text.without(F.split(c, ";"), F.lit("x"))) == ["b", "b"]


def test_sentences(spark):
    assert one(spark, "A b. C d!  Is it? e.f g", text.sentences) == ["A b.", "C d!", "Is it?", "e.f g"]
    assert one(spark, "In context. Fine. It hallucinates.", text.without_context_sentences) == "Fine. It hallucinates."
    assert one(spark, "In context. Fine. It hallucinates.", lambda c: text.without_context_sentences(c, strict=True)) == "Fine."


def test_template(spark):
    fill = lambda context: lambda c: text.fill(c, [("[C]", F.lit(context)), ("[Q]", F.lit("q$1")), ("[A]", F.lit("a\\b"))], optional=("[C]",))
    assert one(spark, "C=[C] Q=[Q] A=[A]", fill("ctx [Q]")) == "C=ctx q$1 Q=q$1 A=a\\b"
    assert one(spark, "C=[C] Q=[Q] A=[A]", fill("")) == "C=[C] Q=q$1 A=a\\b"
    assert one(spark, "one\n[next]\ntwo", text.turns) == ["one", "two"]


def test_clean_report(spark):
    raw = "[ Report de-identified by x\n y]  \nSome TEXT  here_ and __\n more _ tail"
    assert one(spark, raw, text.clean_report) == "some text here and more"
    assert one(spark, "No marks", text.clean_report) == "no marks"


def test_codes_and_json(spark):
    assert one(spark, " 250.0, ,401 ,", text.codes) == ["2500", "401"]
    assert one(spark, 'x [{"q": "a", "l": ["b", "c"], "s": "[sic"}] y', lambda c: text.qa_objects(text.bracketed(c))) == [{"q": "a", "l": "b; c", "s": "[sic"}]
    assert one(spark, "nothing", text.bracketed) is None
    assert one(spark, "broken [ {", lambda c: text.qa_objects(text.bracketed(c))) is None


def test_labels_and_paths(spark):
    label = lambda f: one(spark, f, text.run_label)
    assert label("out/nocot_medical_m.json") == "BCV (Medical)" and label("cot_agnostic.json") == "BCV-CoT (Agnostic)" and label("sca.json") == "SCA (Unknown)" and label("x/plain.json") == "BCV (Unknown)"
    assert label("o/SCA_medical_m.json") == "BCV (Medical)" and label("x.sca") == "BCV (Unknown)" and label("medical/sca.x.json") == "SCA (Unknown)"
    assert one(spark, "a/b_c_llama2-13b.json", text.model_name) == "llama2-13b"
    assert text.output_path("data/x.json", "m:7b") == "data/x_m-7b.json"
    assert one(spark, 3725.0, text.duration, "double") == "1 hours and 2 minutes"


def test_flags_at_the_boundary(spark):
    row = spark.range(1).select(sampling.flag_above(F.lit(0.5), 0.5), sampling.flag_from(F.lit(0.5), 0.5)).first()
    assert tuple(row) == (0, 1)


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(1000)
    a, b = ([r.id for r in sampling.exactly(rows.repartition(n), "id", 7, "s").collect()] for n in (1, 7))
    assert a == b and len(set(a)) == 7
    with pytest.raises(ValueError):
        sampling.exactly(rows.limit(3), "id", 7, "s", strict=True)
    with pytest.raises(ValueError):
        sampling.head(rows, "id", -1)


def test_reports_without_documents(spark):
    reports, qa = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "q"), (1, None)], "id int, question string")
    assert datasets.join_reports(reports, qa, "id", "question").count() == 1
    with pytest.raises(ValueError):
        datasets.join_reports(reports, qa, "id", "question", strict=True)


def test_fixed(spark):
    number = lambda x: one(spark, x, lambda c: text.fixed(c.cast("double"), 3))
    assert [number(x) for x in ("0.0625", "2", "0.6666666", "1e3", "NaN", "-0.0004", None)] == ["0.062", "2.000", "0.667", "1000.000", None, "0.000", None]
