"""Registry of the library's own queries and of the SQL that gives the same rows.

The driver tables hold no answers and verdicts, so each operator runs on columns
of the same shape: ``labels.quality`` for truth, a score with many ties made from
the id, response texts made from the id, and so on. They check what an operator
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions import sampling, text
from quaestor.operators import datasets, evaluate, generate, judge, pages, runs, verdicts

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _u(expr: str, seed: str) -> str:
    return f"(('0x' || substr(md5(({expr})::VARCHAR || '|{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


# --- evaluation -----------------------------------------------------------------

_SCORE = f"floor({_u('l.doc_id', 'score')} * 11) / 10"
_SCORED = f"s AS (SELECT d.source AS run, CASE WHEN l.doc_id % 13 <> 0 THEN {_SCORE} END AS score, l.quality AS y FROM labels l JOIN documents d USING (doc_id))"
_CURVE = f"""WITH {_SCORED},
p AS (SELECT run, score AS threshold, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM s WHERE score IS NOT NULL GROUP BY ALL),
q AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp, sum(n_pos) OVER e AS positives, sum(n_neg) OVER e AS negatives FROM p
  WINDOW w AS (PARTITION BY run ORDER BY threshold DESC), e AS (PARTITION BY run)),
r AS (SELECT * FROM q UNION ALL SELECT DISTINCT run, 'inf'::DOUBLE, 0, 0, 0, 0, positives, negatives FROM q),
c AS (SELECT run, threshold, n_pos, n_neg, tp::BIGINT AS tp, fp::BIGINT AS fp, positives, negatives,
  CASE WHEN negatives > 0 THEN fp::DOUBLE / negatives END AS fpr, CASE WHEN positives > 0 THEN tp::DOUBLE / positives END AS tpr FROM r),
j AS (SELECT *, CASE WHEN tpr IS NULL OR fpr IS NULL THEN CASE WHEN threshold = 'inf'::DOUBLE THEN 0.0 ELSE -1.0 END ELSE tpr - fpr END AS j FROM c),
o AS (SELECT run, threshold, j FROM j QUALIFY row_number() OVER (PARTITION BY run ORDER BY j DESC, threshold DESC) = 1)"""


def _scored(spark, sf_dir) -> DataFrame:
    """Every thirteenth id has no score."""
    score = F.when(F.col("doc_id") % 13 != 0, F.floor(sampling.uniform(F.col("doc_id"), "score") * 11) / 10)
    runs_ = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("run"))
    return _t(spark, sf_dir, "labels").join(runs_, "doc_id").select("run", score.alias("score"), F.col("quality").alias("y"))


def _curve(spark, sf_dir):
    return evaluate.roc_curve(_scored(spark, sf_dir), "run", "score", "y")


@_query("a6_roc_curve", _CURVE + " SELECT run, threshold, fpr, tpr FROM c")
def _roc(spark, sf_dir):
    return _curve(spark, sf_dir).select("run", "threshold", "fpr", "tpr")


@_query("a7_auc", _CURVE + " SELECT run, CASE WHEN max(positives) > 0 AND max(negatives) > 0 THEN sum(n_neg * (2 * tp - n_pos))::DOUBLE / (2.0::DOUBLE * max(positives) * max(negatives)) END AS auc FROM c GROUP BY run")
def _auc(spark, sf_dir):
    return evaluate.auc(_curve(spark, sf_dir))


@_query("a8_optimal_threshold", _CURVE + " SELECT run, threshold, j::DOUBLE AS j FROM o")
def _best(spark, sf_dir):
    return evaluate.optimal_threshold(_curve(spark, sf_dir))


_METRICS = """, k AS (SELECT run, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score < threshold AND y = 0) AS tn,
  count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn FROM s JOIN o USING (run) GROUP BY ALL),
m AS (SELECT *, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS specificity,
  CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END AS fpr, CASE WHEN fn + tp > 0 THEN fn::DOUBLE / (fn + tp) ELSE 0 END AS fnr FROM k)
SELECT *, CASE WHEN precision + sensitivity > 0 THEN 2 * precision * sensitivity / (precision + sensitivity) ELSE 0 END AS f1, (sensitivity + specificity) / 2 AS acc_balanced FROM m"""


@_query("a5_metrics_per_run", _CURVE + _METRICS)
def _metrics(spark, sf_dir):
    """ROC, best threshold, tp/tn/fp/fn (A4) and measures, for each run."""
    rows = _scored(spark, sf_dir)
    return evaluate.metrics(evaluate.confusion(rows, "run", "score", "y", evaluate.optimal_threshold(evaluate.roc_curve(rows, "run", "score", "y"))))


@_query("a9_histogram", f"""WITH {_SCORED}, b AS (SELECT ({' + '.join(f'(score >= {i} * (1.0::DOUBLE / 10))::INT' for i in range(1, 10))}) AS bin FROM s WHERE score BETWEEN 0 AND 1),
n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT i::INT AS bin, i / 10.0::DOUBLE AS low, (i + 1) / 10.0::DOUBLE AS high, coalesce(n, 0) AS n FROM range(10) r(i) LEFT JOIN n ON bin = i""")
def _histogram(spark, sf_dir):
    return evaluate.histogram(_scored(spark, sf_dir), "score")


@_query("a11_a12_u2_run_classes", f"WITH {_SCORED} SELECT y, count(*) AS n, count(DISTINCT run) AS runs FROM s GROUP BY y")
def _classes(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("runs"))


@_query("u2_distinct_labels", f"WITH {_SCORED} SELECT DISTINCT run FROM s")
def _distinct(spark, sf_dir):
    return _scored(spark, sf_dir).select("run").distinct()


@_query("a13_confusion_layout", f"WITH {_SCORED} SELECT y AS actual, count(*) FILTER (score >= 0.5) AS predicted_hallucinated, count(*) FILTER (score < 0.5) AS predicted_factual FROM s GROUP BY y")
def _layout(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("p", (F.col("score") >= 0.5).cast("int"))
    return evaluate.confusion_layout(rows, "y", "p")


@_query("f11_checked_labels", "SELECT doc_id, quality FROM labels")
def _checked(spark, sf_dir):
    return evaluate.check_labels(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "quality")


@_query("p16_runtime_columns", "SELECT doc_id, toxic AS truth, quality AS prediction FROM labels")
def _columns(spark, sf_dir, truth="toxic", prediction="quality"):
    return _t(spark, sf_dir, "labels").select("doc_id", F.col(truth).alias("truth"), F.col(prediction).alias("prediction"))


# --- verdicts -------------------------------------------------------------------

_ANSWERS = ["#Verdict#: Yes", "#Verdict#: No", "#Verdict#: No\n", "**Verdict**: true", "Verdict: False", "x\n#Verdict#: <Yes>", "unclear", "", "#Verdict#: Yes\nbye", "Verdict: True"]
_RESPONSES = "r AS (SELECT doc_id AS qa_id, trial, ([" + ", ".join("'" + a.replace("\n", "' || chr(10) || '") + "'" for a in _ANSWERS) + f"])[1 + floor({_u(chr(39) + 't' + chr(39) + ' || doc_id || ' + chr(39) + '-' + chr(39) + ' || trial', 'resp')} * 10)::INT] AS response FROM documents, range(4) t(trial))"
_LINE = "regexp_replace(string_split({0}, chr(10))[-1], '[^a-zA-Z0-9]', '', 'g')"
_BCV_LINE = _LINE.format(r"regexp_replace(response, '^\s+|\s+$', '', 'g')")
_V = "CASE WHEN regexp_matches({0}, '^Verdict(Yes|True)') THEN {1} WHEN regexp_matches({0}, '^Verdict(No|False)') THEN {2} ELSE 0.5::DOUBLE END"
_BCV = _V.format(_BCV_LINE, "1.0::DOUBLE", "0.0::DOUBLE")
_ISSC = _V.format(_LINE.format("response"), "0.0::DOUBLE", "1.0::DOUBLE")


def _responses(spark, sf_dir) -> DataFrame:
    qa = verdicts.explode_trials(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("qa_id")), 4)
    at = F.floor(sampling.uniform(F.concat(F.lit("t"), "qa_id", F.lit("-"), "trial"), "resp") * 10).cast("int")
    return qa.withColumn("response", F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), at + 1))


@_query("p9_verdict_bcv", f"WITH {_RESPONSES} SELECT qa_id, trial::INT AS trial, {_BCV} AS verdict FROM r")
def _bcv(spark, sf_dir):
    return _responses(spark, sf_dir).select("qa_id", "trial", text.verdict(F.col("response")).alias("verdict"))


@_query("p10_verdict_issc", f"WITH {_RESPONSES} SELECT qa_id, trial::INT AS trial, {_ISSC} AS verdict FROM r")
def _issc(spark, sf_dir):
    return _responses(spark, sf_dir).select("qa_id", "trial", text.verdict(F.col("response"), supported=True, trim=False).alias("verdict"))


@_query("a1_j6_trial_mean", f"WITH {_RESPONSES} SELECT qa_id, avg({_BCV}) AS hallucination_pred FROM r GROUP BY qa_id")
def _trials(spark, sf_dir):
    return verdicts.trial_scores(_responses(spark, sf_dir))


@_query("p11_thresholded_trials", f"WITH {_RESPONSES} SELECT qa_id, (avg({_BCV}) >= 0.5)::INT::DOUBLE AS hallucination_pred FROM r GROUP BY qa_id")
def _thresholded(spark, sf_dir):
    return verdicts.trial_scores(_responses(spark, sf_dir), threshold=0.5)


_SENTENCES = r"string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))"


@_query("j5_a2_a3_contrast_mean", f"""WITH q AS (SELECT item_id AS qa_id, generate_subscripts(ss, 1) - 1 AS sent_no FROM (SELECT item_id, {_SENTENCES} AS ss FROM benchmark)),
r AS (SELECT qa_id, sent_no, sample_no, ([{', '.join("'" + a.replace(chr(10), "' || chr(10) || '") + "'" for a in _ANSWERS)}])[1 + floor({_u("'c' || qa_id || '-' || sent_no || '-' || sample_no", 'resp')} * 10)::INT] AS response FROM q, range(4) s(sample_no)),
a AS (SELECT qa_id, sent_no, avg({_ISSC}) AS s FROM r GROUP BY ALL) SELECT qa_id, avg(s) AS hallucination_pred FROM a GROUP BY qa_id""")
def _contrast(spark, sf_dir):
    """Every sentence of an item with each of four samples."""
    qa = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qa_id"), F.col("text").alias("answer"), F.array(*[F.lit(f"sample {k}") for k in range(4)]).alias("samples"))
    rows = verdicts.sentence_samples(qa)
    at = F.floor(sampling.uniform(F.concat(F.lit("c"), "qa_id", F.lit("-"), "sent_no", F.lit("-"), "sample_no"), "resp") * 10).cast("int")
    return verdicts.contrast_scores(rows.withColumn("response", F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), at + 1)))


@_query("x1_judge_last_turns", """WITH p AS (SELECT item_id AS qa_id, trial, 'Q ' || text AS t0, 'A ' || length(text) AS t1 FROM benchmark, range(2) r(trial)),
h AS (SELECT qa_id, trial::INT AS trial, substr(md5(qa_id || '|' || trial || chr(10) || t0 || chr(10) || t1), 1, 1) AS d FROM p)
SELECT qa_id, trial, CASE WHEN d < '7' THEN 'thought' || chr(10) || '#Verdict#: Yes' WHEN d < 'e' THEN 'thought' || chr(10) || '#Verdict#: No' ELSE 'no verdict' END AS response FROM h""")
def _judged(spark, sf_dir):
    """Two turns a chat through the judge's boundary, with the stand-in judge."""
    rows = verdicts.explode_trials(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qa_id"), F.array(F.concat(F.lit("Q "), "text"), F.concat(F.lit("A "), F.length("text").cast("string"))).alias("turns")), 2)
    return judge.last_turn(judge.ask_all(rows, judge.HashJudge()))


# --- test sets ------------------------------------------------------------------

_QA = f"q AS (SELECT p_partkey AS id, p_type AS context, p_name AS question, p_brand AS right_answer, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS wrong_answer FROM part)"


def _qa(spark, sf_dir) -> DataFrame:
    wrong = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("context"), F.col("p_name").alias("question"), F.col("p_brand").alias("right_answer"), wrong.alias("wrong_answer"))


@_query("p1_p2_p3_p4_f6_qa_test", f"WITH {_QA}, f AS (SELECT *, ({_u('id', 'flag')} > 0.6)::INT AS hallucination FROM q) SELECT id, context, question, CASE WHEN hallucination = 1 THEN wrong_answer ELSE right_answer END AS answer, hallucination FROM f WHERE CASE WHEN hallucination = 1 THEN wrong_answer ELSE right_answer END <> ''")
def _test_set(spark, sf_dir):
    return datasets.qa_test(_qa(spark, sf_dir), "id", 0.6, "flag", "question", "right_answer", "wrong_answer", "context")


@_query("p4_precision_flag", f"WITH {_QA} SELECT id, CASE WHEN {_u('id', 'flag')} < 0.6 THEN 0 ELSE 1 END AS hallucination FROM q")
def _flags(spark, sf_dir):
    return _qa(spark, sf_dir).select("id", sampling.flag_from(sampling.uniform(F.col("id"), "flag"), 0.6).alias("hallucination"))


@_query("st7_u3_l4_f7_samples", f"""WITH p AS (SELECT p_partkey AS id, string_split(p_type || '; ' || p_name || ';' || p_type, ';') AS c FROM part),
a AS (SELECT id, c, c[1 + (('0x' || substr(md5(id::VARCHAR || '|pick'), 1, 8))::BIGINT % len(c))::INT] AS answer FROM p),
s AS (SELECT id, answer, [x FOR x IN c IF x <> answer] AS samples FROM a)
SELECT id, answer, array_to_string(samples, '|') AS samples FROM s WHERE len(samples) > 0""")
def _samples(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat("p_type", F.lit("; "), "p_name", F.lit(";"), "p_type"), ";").alias("c"))
    rows = datasets.with_samples(rows.withColumn("answer", sampling.choice(F.col("c"), F.col("id"), "pick")), "answer", F.col("c"))
    return rows.select("id", "answer", F.array_join("samples", "|").alias("samples"))


@_query("p5_j1_report_blocks", """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS c, o_orderpriority AS a FROM orders), l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_returnflag AS f FROM lineitem)
SELECT id, n, 'Chief Complaint: ' || c || chr(10) || 'Admit Diagnosis: ' || a || chr(10) || 'Discharge Diagnosis:' || chr(10) || ' - ' || a || chr(10) || ' - ' || f || chr(10) || 'Report Text: ' || c || chr(10) || chr(10) AS context FROM o JOIN l USING (id) WHERE f IS NOT NULL""")
def _reports(spark, sf_dir):
    reports = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("c"), F.col("o_orderpriority").alias("a"))
    qa = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"))
    rows = datasets.join_reports(reports, qa, "id", "f")
    return rows.select("id", "n", text.report_block(F.col("c"), F.col("a"), F.array("a", "f"), F.col("c")).alias("context"))


@_query("f12_null_documents", "SELECT doc_id, text FROM documents WHERE CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END IS NOT NULL")
def _null_documents(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    return datasets.filled(rows, "text", empty=True)


_PAIRS = "q AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'What are (are) ' || p_name WHEN 1 THEN p_name || ' - resources ?' WHEN 2 THEN 'Do you have information (are) about ' || p_name WHEN 3 THEN NULL ELSE p_name END AS question, CASE WHEN p_size % 7 = 0 THEN 'No information found.' WHEN p_size % 7 = 1 THEN NULL ELSE p_brand END AS answer FROM part)"


@_query("f4_st4_st5_good_pairs", f"WITH {_PAIRS}, c AS (SELECT id, replace(question, ' (are)', '') AS question, answer FROM q) SELECT * FROM c WHERE question IS NOT NULL AND NOT ends_with(question, ' - resources ?') AND NOT starts_with(question, 'Do you have information about ') AND answer <> 'No information found.'")
def _good_pairs(spark, sf_dir):
    name, k = F.col("p_name"), F.col("p_size") % 5
    question = F.when(k == 0, F.concat(F.lit("What are (are) "), name)).when(k == 1, F.concat(name, F.lit(" - resources ?"))).when(k == 2, F.concat(F.lit("Do you have information (are) about "), name)).when(k == 4, name)
    answer = F.when(F.col("p_size") % 7 == 0, "No information found.").when(F.col("p_size") % 7 != 1, F.col("p_brand"))
    return datasets.good_pairs(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), question.alias("question"), answer.alias("answer")), "question", "answer")


_SOURCES = "s AS (SELECT p_partkey AS id, (['1_CancerGov_QA', '2_GARD_QA', '5_NIDDK_QA', 'readme', '10_MPlus_ADAM_QA', '7_SeniorHealth_QA'])[1 + p_size % 6] AS source FROM part)"


@_query("f8_j8_usable_sources", f"WITH {_SOURCES} SELECT * FROM s WHERE regexp_matches(source, '^[0-9]') AND source NOT IN ('2_GARD_QA', '6_NINDS_QA', '7_SeniorHealth_QA', '9_CDC_QA', '5_NIDDK_QA')")
def _sources(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("1_CancerGov_QA", "2_GARD_QA", "5_NIDDK_QA", "readme", "10_MPlus_ADAM_QA", "7_SeniorHealth_QA")])
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(names, (1 + F.col("p_size") % 6).cast("int")).alias("source"))
    return datasets.usable_sources(rows, "source")


@_query("f1_f2_file_names", "WITH n AS (SELECT page_id, 'report' || page_id || CASE WHEN page_id % 3 = 0 THEN '_cot.json' WHEN page_id % 3 = 1 THEN '_cot.log' ELSE '.json' END AS name FROM pages) SELECT * FROM n WHERE ends_with(name, '.json') AND contains(name, '_cot') AND contains(name, 'report')")
def _file_names(spark, sf_dir):
    k = F.col("page_id") % 3
    rows = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("report"), "page_id", F.when(k == 0, "_cot.json").when(k == 1, "_cot.log").otherwise(".json")).alias("name"))
    return rows.filter(text.chosen(F.col("name"), ".json", "_cot", "report"))


@_query("f5_empty_contexts", "WITH c AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE url END AS context FROM pages) SELECT * FROM c WHERE context IS NOT NULL AND context <> ''")
def _contexts(spark, sf_dir):
    k = F.col("page_id") % 4
    rows = _t(spark, sf_dir, "pages").select("page_id", F.when(k == 0, "").when(k > 1, F.col("url")).alias("context"))
    return datasets.filled(rows, "context")


@_query("j2_code_lookup", "WITH c AS (SELECT c_custkey AS id, c_nationkey * 2 AS code FROM customer) SELECT id, code::INT AS code, coalesce(n_name, 'Unknown diagnosis code') AS description FROM c LEFT JOIN nation ON code = n_nationkey")
def _lookup(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 2).alias("code"))
    names = datasets.last_of_each(_t(spark, sf_dir, "nation").withColumnRenamed("n_name", "description"), "n_nationkey", "description", "n_regionkey")
    return datasets.look_up(rows, "code", names, "n_nationkey", "description")


@_query("j3_ar1_code_lists", """WITH c AS (SELECT c_custkey AS id, [c_nationkey, c_nationkey * 2, 3] AS codes FROM customer), e AS (SELECT id, generate_subscripts(codes, 1) AS pos, unnest(codes) AS code FROM c)
SELECT id, string_agg(coalesce(n_name, 'Unknown diagnosis code'), '|' ORDER BY pos) AS descriptions FROM e LEFT JOIN nation ON code = n_nationkey GROUP BY id""")
def _lookup_all(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array("c_nationkey", F.col("c_nationkey") * 2, F.lit(3)).alias("codes"))
    out = datasets.look_up_all(rows, "id", "codes", _t(spark, sf_dir, "nation").withColumnRenamed("n_name", "description"), "n_nationkey", "description")
    return out.select("id", F.array_join("descriptions", "|").alias("descriptions"))


@_query("j8_known_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _unlabelled(spark, sf_dir):
    return datasets.known(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id", wanted=False)


@_query("u1_append", "SELECT 'd' || doc_id AS doc_id, lang, NULL::VARCHAR AS item_id FROM documents UNION ALL SELECT NULL, NULL, 'i' || item_id FROM benchmark")
def _append(spark, sf_dir):
    return datasets.append(_t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "lang"), _t(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), "item_id").alias("item_id")))


# --- sampling -------------------------------------------------------------------


@_query("l1_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def _head(spark, sf_dir):
    return sampling.head(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 20)


@_query("l2_exact_sample", "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id::VARCHAR || '|50'), doc_id LIMIT 50")
def _exact(spark, sf_dir):
    return sampling.exactly(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50, 50)


@_query("l3_shuffle_key", "SELECT doc_id, md5(doc_id::VARCHAR || '|order') AS k FROM documents")
def _shuffled(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", sampling.key(F.col("doc_id"), "order").alias("k"))
    return rows.orderBy("k", "doc_id")


@_query("l5_w3_stratified", """WITH d AS (SELECT doc_id, source, lang, md5(doc_id::VARCHAR || '|s') AS k, md5(doc_id::VARCHAR || '|s|files') AS k2 FROM documents),
o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY k, doc_id) = 1)
SELECT doc_id, source, lang FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY k2, doc_id) <= 2""")
def _stratified(spark, sf_dir):
    return sampling.stratified(_t(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "lang", "doc_id", 2, "s")


@_query("rnd_uniform", f"SELECT doc_id, {_u('doc_id', 'x')} AS u FROM documents")
def _uniform(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", sampling.uniform(F.col("doc_id"), "x").alias("u"))


# --- templates and labels -------------------------------------------------------


@_query("p6_template_fill", "WITH t AS (SELECT p_partkey AS id, 'C=[C] Q=[Q] A=[A]' AS b, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'ctx [Q] ' || p_type END AS c, p_name || ' $1 \\' AS q, p_brand AS a FROM part) SELECT id, replace(replace(CASE WHEN c IS NULL OR c = '' THEN b ELSE replace(b, '[C]', c) END, '[Q]', q), '[A]', a) AS prompt FROM t")
def _filled(spark, sf_dir):
    context = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 2, F.concat(F.lit("ctx [Q] "), "p_type"))
    slots = [("[C]", context), ("[Q]", F.concat("p_name", F.lit(" $1 \\"))), ("[A]", F.col("p_brand"))]
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.fill(F.lit("C=[C] Q=[Q] A=[A]"), slots, optional=("[C]",)).alias("prompt"))


@_query("p7_st15_slots_and_json", """SELECT p_partkey AS id, replace(replace('R: [R] S: [S]', '[R]', '{"name":"' || p_name || '","size":' || p_size || '}'), '[S]', p_brand) AS prompt FROM part""")
def _slots(spark, sf_dir):
    report = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.fill(F.lit("R: [R] S: [S]"), [("[R]", report), ("[S]", F.col("p_brand"))]).alias("prompt"))


@_query("p8_chat_turns", "WITH c AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) || '[next]' || chr(10) ORDER BY turn) AS p FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, string_split(p, chr(10) || '[next]' || chr(10)) AS ts FROM c) SELECT conv_id, (generate_subscripts(ts, 1) - 1)::INT AS turn, unnest(ts) AS content FROM s")
def _chat_turns(spark, sf_dir):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("x")))), lambda s: s["x"]), "\n[next]\n")
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined.alias("p"))
    return rows.select("conv_id", F.posexplode(text.turns(F.col("p"))).alias("turn", "content"))


_NAMES = "n AS (SELECT page_id, 'out/x_' || (['nocot_medical', 'cot_agnostic', 'SCA_medical', 'plain', 'sca_agnostic'])[1 + page_id % 5] || '_llama2-' || page_id % 3 || 'b.json' AS f FROM pages)"


def _names(spark, sf_dir) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("nocot_medical", "cot_agnostic", "SCA_medical", "plain", "sca_agnostic")])
    kind = F.element_at(kinds, (1 + F.col("page_id") % 5).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("out/x_"), kind, F.lit("_llama2-"), F.col("page_id") % 3, F.lit("b.json")).alias("f"))


@_query("p12_run_labels", f"WITH {_NAMES}, l AS (SELECT page_id, regexp_replace(string_split(f, '/')[-1], '\\.[^.]*$', '') AS b FROM n) SELECT page_id, CASE WHEN contains(b, 'nocot') THEN 'BCV' WHEN contains(b, 'cot') THEN 'BCV-CoT' WHEN contains(b, 'sca') THEN 'SCA' ELSE 'BCV' END || ' (' || CASE WHEN contains(b, 'medical') THEN 'Medical' WHEN contains(b, 'agnostic') THEN 'Agnostic' ELSE 'Unknown' END || ')' AS label FROM l")
def _labels(spark, sf_dir):
    return _names(spark, sf_dir).select("page_id", text.run_label(F.col("f")).alias("label"))


@_query("p13_st9_model_names", f"WITH {_NAMES} SELECT page_id, string_split(regexp_replace(f, '\\.[^.]*$', ''), '_')[-1] AS model FROM n")
def _models(spark, sf_dir):
    return _names(spark, sf_dir).select("page_id", text.model_name(F.col("f")).alias("model"))


# --- scalar functions -----------------------------------------------------------


def _documents(name: str, sql: str):
    """A query of one column over documents.text."""

    def keep(f):
        _query(name, f"SELECT doc_id, {sql} AS out FROM documents")(lambda spark, sf_dir: _t(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("out")))
        return f

    return keep


_documents("st1_alphanumeric", "regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')")(text.alphanumeric)
_documents("st2_last_line", "string_split(text, chr(10))[-1]")(text.last_line)
_documents("st3_strip", r"regexp_replace('  ' || text || chr(10) || ' ', '^\s+|\s+$', '', 'g')")(lambda c: text.strip(F.concat(F.lit("  "), c, F.lit("\n ")), unicode=False))
_documents("st10_before_first", "string_split(text, '. ')[1]")(lambda c: text.before_first(c, ". "))
_documents("st11_ar2_sentences", f"array_to_string({_SENTENCES}, '|')")(lambda c: F.array_join(text.sentences(c), "|"))
_documents("f13_d3_sentence_filter", f"array_to_string([s FOR s IN string_split(regexp_replace(replace(text, 'the', 'Context'), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) IF NOT contains(lower(s), 'context')], ' ')")(lambda c: text.without_context_sentences(F.replace(c, F.lit("the"), F.lit("Context"))))
_documents("st6_clean_text", r"trim(regexp_replace(lower(replace(regexp_replace(regexp_replace('[ Report de-identified x' || chr(10) || ' y]  ' || chr(10) || replace(text, '. ', '_ '), '(?s)^\[\s*Report de-identified .+?\]\s*\n', ''), '(?s)^(.*)_.*$', '\1'), '_', '')), '\s+', ' ', 'g'))")(
    lambda c: text.clean_report(F.concat(F.lit("[ Report de-identified x\n y]  \n"), F.replace(c, F.lit(". "), F.lit("_ "))))
)
_documents("st17_st18_lower_contains", "contains(lower(text), 'the and')")(lambda c: text.mentions(c, "The and"))
_documents("st13_bracketed", r"nullif(regexp_extract(replace(text, 'e', '[') || ' ' || replace(text, 'o', ']'), '(?s)(\[.*\])', 1), '')")(
    lambda c: text.bracketed(F.concat(F.replace(c, F.lit("e"), F.lit("[")), F.lit(" "), F.replace(c, F.lit("o"), F.lit("]"))))
)


@_query("st8_code_lists", r"WITH p AS (SELECT p_partkey AS id, ' ' || p_size || '.1 , ,' || p_brand || '.x,,' || p_size || ' ' AS c FROM part) SELECT id, array_to_string([replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '.', '') FOR x IN string_split(c, ',') IF regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''], '|') AS codes FROM p")
def _codes(spark, sf_dir):
    c = F.concat(F.lit(" "), "p_size", F.lit(".1 , ,"), "p_brand", F.lit(".x,,"), "p_size", F.lit(" "))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.codes(c), "|").alias("codes"))


@_query("st14_f10_u4_json_objects", """WITH e AS (SELECT event_id, event_id % 5 AS kind, props::JSON->>'k' AS k FROM events)
SELECT event_id, kind >= 3 AS ok, CASE kind WHEN 3 THEN 0 WHEN 4 THEN 2 END::INT AS n, CASE kind WHEN 4 THEN 'q' || k END AS question, CASE kind WHEN 4 THEN 'a; b' END AS right_answer FROM e""")
def _json(spark, sf_dir):
    """Responses without a list, with other keys, with broken JSON, with an empty list, and with two good objects."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    good = F.concat(F.lit('Here [{"question":"q'), k, F.lit('","right_answer":["a","b"],"hallucinated_answer":"c"},{"hallucinated_answer":"d","question":"r","right_answer":"e"}] it is'))
    made = F.when(kind == 0, "nothing here").when(kind == 1, '[{"question":"q","right_answer":"a"}]').when(kind == 2, '[{"question": broken]').when(kind == 3, "none: [].").otherwise(good)
    rows = generate.documents_of_pairs(_t(spark, sf_dir, "events").select("event_id", made.alias("response")), "event_id", "response")
    first = F.try_element_at("pairs", F.lit(1))
    return rows.select("event_id", "ok", F.when(F.col("ok"), F.size("pairs")).alias("n"), first["question"].alias("question"), first["right_answer"].alias("right_answer"))


@_query("st16_url_parts", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def _url_parts(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for c, n in zip(text.url_parts(F.col("url")), ("authority", "path"), strict=True)])


@_query("a10_st19_s12_run_times", """WITH l AS (SELECT event_id, floor(abs(value) * 100)::BIGINT AS s, user_id FROM events), g AS (SELECT count(*) AS runs, sum(s)::DOUBLE AS seconds FROM l WHERE user_id % 3 <> 0)
SELECT runs, seconds, floor(seconds / 3600)::BIGINT || ' hours and ' || floor(seconds / 60)::BIGINT % 60 || ' minutes' AS duration FROM g""")
def _times(spark, sf_dir):
    """Logs of which two thirds end with the line of a run that finished."""
    end = F.concat(F.lit("Finished after "), F.floor(F.abs("value") * 100).cast("string"), F.lit(" seconds"))
    content = F.concat(F.lit("=== run\nmodel x\n"), F.when(F.col("user_id") % 3 != 0, end).otherwise("stopped"), F.lit("\n"))
    return runs.total_time(_t(spark, sf_dir, "events").select(content.alias("content")))


@_query("s8_first_tag", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, CASE WHEN p_size % 3 = 0 THEN p_brand END) AS found FROM part")
def _first_tag(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.first_present(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))).alias("found"))


# --- pages ----------------------------------------------------------------------

_URLS = "u AS (SELECT page_id, 'https://' || (['www.cancer.gov/x', 'ghr.nlm.nih.gov/x', 'www.niddk.nih.gov/x', 'www.nhlbi.nih.gov/x', 'www.nlm.nih.gov/medlineplus/ency/1', 'www.nlm.nih.gov/medlineplus/druginfo/meds/2', 'www.nlm.nih.gov/medlineplus/druginfo/natural/3', 'www.nlm.nih.gov/medlineplus/z', 'other.example.com/y'])[1 + page_id % 9] AS url FROM pages)"


@_query("h1_h9_routes", f"""WITH {_URLS}, h AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS h, regexp_extract(url, '//[^/]*(.*)', 1) AS p FROM u)
SELECT page_id, CASE h WHEN 'www.cancer.gov' THEN 'H1' WHEN 'ghr.nlm.nih.gov' THEN 'H2' WHEN 'www.niddk.nih.gov' THEN 'H3' WHEN 'www.nhlbi.nih.gov' THEN 'H4' WHEN 'www.nlm.nih.gov' THEN
  CASE WHEN starts_with(p, '/medlineplus/ency') THEN 'H5' WHEN starts_with(p, '/medlineplus/druginfo/meds') THEN 'H6' WHEN starts_with(p, '/medlineplus/druginfo/natural') THEN 'H7' ELSE 'H8' END END AS rule FROM h""")
def _routes(spark, sf_dir):
    tails = F.array(*[F.lit(x) for x in ("www.cancer.gov/x", "ghr.nlm.nih.gov/x", "www.niddk.nih.gov/x", "www.nhlbi.nih.gov/x", "www.nlm.nih.gov/medlineplus/ency/1", "www.nlm.nih.gov/medlineplus/druginfo/meds/2", "www.nlm.nih.gov/medlineplus/druginfo/natural/3", "www.nlm.nih.gov/medlineplus/z", "other.example.com/y")])
    url = F.concat(F.lit("https://"), F.element_at(tails, (1 + F.col("page_id") % 9).cast("int")))
    return _t(spark, sf_dir, "pages").select("page_id", pages.route(url).alias("rule"))


@_query("h1_h8_page_contents", "WITH p AS (SELECT page_id, 'https://x/' || page_id AS u, ([" + ", ".join(f"'{r.cut}'" for r in pages.RULES) + r"])[1 + page_id % 8] AS cut, url FROM pages) SELECT page_id, 'Page ' || page_id || chr(10) || url || chr(10) || CASE WHEN cut = '' THEN 'the end' ELSE '' END AS content FROM p")
def _by_rule(spark, sf_dir):
    """A page for each rule, with all that the rule drops and its mark."""

    def tag(what: pages.Select, inner: str = "") -> str:
        return f"<{what.tag}{f' {what.attr}="a {what.value}"' if what.attr == 'class' else f' {what.attr}="{what.value}"' if what.attr else ''}>{what.text or inner}</{what.tag}>"

    def page(rule: pages.Rule):
        one = lambda d: f"<div>{tag(d.what, 'x')}</div>" if d.parent else tag(d.what, "x")
        head = "".join(one(d) + (f"<{d.sibling}><i>gone</i></{d.sibling}>" if d.sibling else "") for d in rule.drops)
        main = tag(rule.main[0], head + "\0<b>" + (rule.cut or "the end") + "</b>" + ("<p>tail</p>" if rule.cut else ""))
        before, after = f"<body><p>menu</p>{main}<p>foot</p></body>".split("\0")
        return F.concat(F.lit(before + "<p> Page "), F.col("page_id"), F.lit(" </p>\n<script>s()</script><p>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</p>" + after))

    rules = F.array(*[F.lit(f"https://{r.host}{r.path}/") for r in pages.RULES])
    k = F.col("page_id") % 8
    html = F.element_at(F.array(*[page(r) for r in pages.RULES]), (1 + k).cast("int"))
    rows = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.element_at(rules, (1 + k).cast("int")), "page_id").alias("at"), html.alias("html"))
    return pages.contents(rows, "at").join(rows.select("page_id", F.col("at").alias("url")), "url").select("page_id", "content")


#: The pages' articles have no other references than these two, whole or cut off.
_ARTICLES = r"""f AS (SELECT url, min(html) AS html FROM pages GROUP BY url),
a AS (SELECT url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS inner_html FROM f),
b AS (SELECT url, [x FOR x IN [trim(regexp_replace(y, '^\s+|\s+$', '', 'g')) FOR y IN regexp_split_to_array(inner_html, '<[^>]*>')] IF x <> ''] AS parts FROM a),
t AS (SELECT url, replace(replace(replace(array_to_string(parts, chr(10)), '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS content FROM b)"""


@_query("h10_h13_s9_page_contents", f"WITH {_ARTICLES} SELECT url, content FROM t")
def _contents(spark, sf_dir):
    """Text of each distinct URL's article; the hosts here have no rule of their own."""
    return pages.contents(_t(spark, sf_dir, "pages"), default=pages.ARTICLE)


@_query("j4_url_memo", f"WITH {_ARTICLES} SELECT page_id, url, content FROM pages JOIN t USING (url)")
def _memo(spark, sf_dir):
    """Rows with the content of their page, which is parsed once for each URL."""
    rows = _t(spark, sf_dir, "pages")
    return pages.with_contents(rows.select("page_id", "url"), rows, "url", default=pages.ARTICLE)


# --- generation and runs --------------------------------------------------------


def _stage(spark, sf_dir, response) -> tuple[DataFrame, DataFrame]:
    """Questions, and responses that a model gave to them in two turns; every seventh call failed at first."""
    part = _t(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_brand").alias("right_answer"))
    asked = part.select(F.col("p_partkey").alias("qa_id"), F.lit(0).alias("trial"), response.alias("last"))
    turn = lambda k, r: asked.select("qa_id", "trial", F.lit(k).alias("turn"), r.alias("response"), F.lit(None).cast("string").alias("error"))
    failed = turn(1, F.lit(None).cast("string")).filter("qa_id % 7 = 0")
    return rows, turn(0, F.lit("thinking")).unionByName(turn(1, F.col("last"))).filter("qa_id % 11 <> 0").unionByName(failed)


@_query("x7_d4_regenerated", "SELECT p_partkey AS id, p_name AS question, CASE WHEN p_partkey % 11 = 0 OR p_size % 3 = 0 THEN p_brand ELSE 'New ' || p_type END AS right_answer FROM part")
def _regenerated(spark, sf_dir):
    rows, responses = _stage(spark, sf_dir, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Sorry: Missing information on "), "p_type")).otherwise(F.concat(F.lit("New "), "p_type")))
    return generate.regenerated(rows, responses, "id")


@_query("x7_d4_regenerated_dropping", "SELECT p_partkey AS id, p_name AS question, CASE WHEN p_partkey % 11 = 0 THEN p_brand ELSE 'New ' || p_type END AS right_answer FROM part WHERE p_partkey % 11 = 0 OR p_size % 3 <> 0")
def _regenerated_dropping(spark, sf_dir):
    rows, responses = _stage(spark, sf_dir, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Sorry: Missing information on "), "p_type")).otherwise(F.concat(F.lit("New "), "p_type")))
    return generate.regenerated(rows, responses, "id", drop_missing=True)


@_query("x7_f13_hallucinated", "SELECT p_partkey AS id, p_name AS question, p_brand AS right_answer, CASE WHEN p_partkey % 11 <> 0 THEN 'It is ' || p_type || '.' || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' I hallucinate!' END END AS hallucinated_answer FROM part")
def _hallucinated(spark, sf_dir):
    """Sentences on the context go, those on hallucinating stay unless asked for."""
    tail = F.when(F.col("p_size") % 2 == 0, " The Context says so.").otherwise(" I hallucinate!")
    rows, responses = _stage(spark, sf_dir, F.concat(F.lit("It is "), "p_type", F.lit("."), tail))
    return generate.hallucinated(rows, responses, "id")


@_query("f9_checked_models", "SELECT page_id, 'm' || page_id % 3 AS model FROM pages")
def _models_checked(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("m"), F.col("page_id") % 3).alias("model"))
    return generate.checked_models(rows, "model", ["m0", "m1", "m2"])


@_query("st20_fixed_digits", "SELECT p_partkey AS id, printf('%.3f', p_size / 7.0::DOUBLE) AS three, printf('%.2f', p_retailprice / 3) AS two FROM part")
def _fixed(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.fixed(F.col("p_size") / F.lit(7.0), 3).alias("three"), text.fixed(F.col("p_retailprice") / 3, 2).alias("two"))


@_query("k3_dt1_run_logs", """SELECT event_id, repeat('=', 49) || chr(10) || event_type || chr(10) || 'Current time ' || printf('%.2f', (1700000000 + event_id)::DOUBLE) || chr(10) || 'model: m' || chr(10) || 'times: ' || user_id % 5 || chr(10) || chr(10)
 || CASE WHEN user_id % 3 <> 0 THEN 'Finished after ' || floor(abs(value) * 100)::BIGINT || '.00 seconds' || chr(10) ELSE '' END AS content FROM events""")
def _run_logs(spark, sf_dir):
    """Runs as the text of their logs; runs that failed have no last line."""
    settings = F.create_map(F.lit("times"), (F.col("user_id") % 5).cast("string"), F.lit("model"), F.lit("m"))
    seconds = F.when(F.col("user_id") % 3 != 0, F.floor(F.abs("value") * 100).cast("double"))
    rows = _t(spark, sf_dir, "events")
    return rows.select("event_id", runs.log_text(F.col("event_type"), settings, (F.lit(1700000000) + F.col("event_id")).cast("double"), seconds).alias("content"))
