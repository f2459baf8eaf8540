import corpus_pipeline
from quaestor.llm import decontaminate, exact_dedup, quality, simhash
from quaestor.llm.registry import oracle_sql, queries


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        after = corpus_pipeline.materialise(after)
        assert after.columns == columns and after.subtract(docs).isEmpty(), name
        docs = after
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    assert exact_dedup.classes(docs).filter("group_size > 1").isEmpty()
    found = simhash.near_classes(docs)
    assert found.select("component_id").distinct().count() == docs.count()
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.decontaminate(docs, benchmark).count() == docs.count()
    first = quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert first.filter("keep").count() == sizes[1]
    mixed = corpus_pipeline.run(spark, sf_dir)
    assert mixed.columns == [*columns, "copy_no"] and mixed.select("doc_id").subtract(docs.select("doc_id")).isEmpty()


def test_stages_take_odd_tables(spark, sf_dir):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 1), (1, "", "en", "a", 0, 1), (2, "word " * 60000, None, None, 5, 2), (3, "some text of few words", "xx", "b", 1, 3)]
    for data in (rows, []):
        df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest int")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf_dir)
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "digest"]
        corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).collect()


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
