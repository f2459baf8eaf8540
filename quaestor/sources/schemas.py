"""Declared schemas of the data sets."""

EHR_REPORT = "chief_complaint string, admit_diagnosis string, discharge_diagnosis array<string>, report_text string"
QCH = "question string, right_answer string, hallucinated_answer string"
MEDQUAD = "question string, right_answer string, context string, hallucinated_answer string"
HALUEVAL = "knowledge string, question string, right_answer string, hallucinated_answer string"
QA_TEST = "context string, question string, answer string, hallucination int"
QA_TEST_SAMPLES = "question string, answer string, samples array<string>, hallucination int"
PREDICTIONS = QA_TEST + ", hallucination_pred double"
RESPONSES = "qa_id bigint, trial int, turn int, response string, error string"
