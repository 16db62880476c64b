import corpus_pipeline
from tests.llm.conftest import SMALL, odd_texts
from tests.llm.test_packing import check_layout
from trajspark.llm import dedup, language, quality, simhash
from trajspark.session import materialize


def test_stages_keep_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    expected = docs
    left = []
    for (_, stage), says in zip(corpus_pipeline.STAGES[:-1], (
        lambda d: {r.doc_id for r in language.identify(d, language.learn(d)).collect() if r.lang_pred != "und" and r.score >= language.MIN_SCORE},
        lambda d: {r.doc_id for r in quality.score(d, quality.learn(d, labels)).collect() if r.score >= quality.THRESHOLD},
        lambda d: {r.keep_id for r in dedup.exact_groups(d).collect()},
        lambda d: {r.component_id for r in simhash.near_groups(d).collect()},
    )):
        result = materialize(stage(spark, expected, SMALL), "t")
        assert result.columns == docs.columns
        got = [r.doc_id for r in result.collect()]
        assert len(got) == len(set(got)) and set(got) == says(expected)
        expected = result
        left.append(len(got))
    assert left == sorted(left, reverse=True) and left[-1] > 500
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == set(got)
    check_layout(packed)


def test_odd_rows_pass_through(docs, spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a b"), (6, "a b"), (None, None)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    check_layout(corpus_pipeline.run(spark, str(tmp_path)).collect())
    docs([]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_python_gets_few_rows_at_a_time_and_profiles_stay(spark):
    import pyarrow as pa

    from trajspark.llm import common, language

    docs = common.table(spark, SMALL, "documents")
    before = spark.conf.get(common.BATCH_CONF)
    whole = language.learn(docs)
    try:
        common.small_batches(spark)
        sizes = spark.range(0, 3000, 1, 1).mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long"
        ).collect()
        assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) <= 512
        spark.conf.set(common.BATCH_CONF, "7")
        small = language.learn(docs)
    finally:
        spark.conf.set(common.BATCH_CONF, before)
    assert whole.keys() == small.keys() and all(whole[k].tolist() == small[k].tolist() for k in whole)
