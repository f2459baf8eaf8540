import math
import random

import pytest

from quaestor.operators import evaluate as ev
from quaestor.operators import verdicts


def curve(spark, y, s, run="r"):
    return ev.roc_curve(spark.createDataFrame([(run, float(a), b) for a, b in zip(s, y, strict=True)], "run string, s double, y int"), "run", "s", "y")


def test_roc_of_four_points(spark):
    c = curve(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    got = [(r.threshold, r.fpr, r.tpr) for r in c.orderBy("threshold", ascending=False).collect()]
    assert got == [(math.inf, 0, 0), (0.8, 0, 0.5), (0.4, 0.5, 0.5), (0.35, 0.5, 1), (0.1, 1, 1)]
    assert ev.auc(c).first().auc == 0.75
    best = ev.optimal_threshold(c)
    assert best.first().threshold == 0.8
    rows = spark.createDataFrame([("r", 0.1, 0), ("r", 0.4, 0), ("r", 0.35, 1), ("r", 0.8, 1)], "run string, s double, y int")
    m = ev.metrics(ev.confusion(rows, "run", "s", "y", best)).first()
    assert (m.tp, m.tn, m.fp, m.fn, m.accuracy, m.precision, m.sensitivity, m.specificity, m.fpr, m.fnr, m.acc_balanced) == (1, 2, 0, 1, 0.75, 1, 0.5, 1, 0, 0.5, 0.75)
    assert math.isclose(m.f1, 2 / 3)


def test_curve_properties(spark):
    rng = random.Random(1)
    y, s = [rng.randrange(2) for _ in range(800)], [rng.choice([round(rng.random(), 2), rng.random(), -1.0, 3.0]) for _ in range(800)]
    c = curve(spark, y, s)
    pairs = [(r.fpr, r.tpr) for r in c.orderBy("threshold", ascending=False).collect()]
    assert pairs[0] == (0, 0) and pairs[-1] == (1, 1) and pairs == sorted(pairs)
    wins = sum((a > b) + 0.5 * (a == b) for a, p in zip(s, y, strict=True) if p for b, q in zip(s, y, strict=True) if not q)
    assert math.isclose(ev.auc(c).first().auc, wins / (sum(y) * (800 - sum(y))))
    assert math.isclose(ev.auc(curve(spark, y, [1 - x for x in s])).first().auc, 1 - ev.auc(c).first().auc)


def test_one_class(spark):
    c = curve(spark, [1, 1], [0.2, 0.9])
    assert ev.auc(c).first().auc is None and ev.optimal_threshold(c).first().threshold == math.inf


def test_histogram(spark):
    rows = spark.createDataFrame([(k / 10,) for k in range(11)] + [(-0.1,), (1.1,), (None,)], "v double")
    got = {r.bin: r.n for r in ev.histogram(rows, "v").collect()}
    assert [got[k] for k in range(10)] == [1, 1, 2, 0, 1, 2, 1, 0, 1, 2]


def test_guards(spark):
    m = ev.metrics(spark.createDataFrame([(0, 3, 0, 0)], "tp long, tn long, fp long, fn long")).first()
    assert (m.accuracy, m.precision, m.sensitivity, m.f1) == (1, 0, 0, 0)
    with pytest.raises(Exception, match="must be 0 or 1"):
        ev.check_labels(spark.createDataFrame([(2,)], "y int"), "y").collect()


def test_contrast_and_trials(spark):
    qa = spark.createDataFrame([(1, "A b. C d.", ["s", "t"])], "qa_id long, answer string, samples array<string>")
    assert verdicts.sentence_samples(qa).count() == 4
    with pytest.raises(ValueError):
        verdicts.explode_trials(qa, 0)
    rows = spark.createDataFrame([(1, 0, "Verdict: Yes"), (1, 0, "Verdict: No"), (1, 1, "Verdict: No"), (1, 1, "Verdict: No")], "qa_id long, sent_no int, response string")
    assert verdicts.contrast_scores(rows).first().hallucination_pred == 0.75
