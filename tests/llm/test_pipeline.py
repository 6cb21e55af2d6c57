"""The pipeline's stages against brute force on small tables."""

import corpus_pipeline
from larder.llm import simhash, toxicity
from larder.llm.common import table


def test_stages_in_order_and_columns(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "sentencepiece"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(names) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        old, new = before.select("doc_id").distinct().count(), docs.select("doc_id").distinct().count()
        if name == "toxicity":
            model = toxicity.train(before, table(spark, sf_dir, "labels"))
            assert new == toxicity.score(before, model).where("score < 0.3").select("doc_id").distinct().count()
        elif name == "simhash_dedup":
            groups = simhash.similar_documents(before).select("component_id").distinct().count()
            assert docs.count() == new == groups
        else:
            assert new == old


def test_exact_copies_leave_one(spark, sf_dir):
    rows = [(i, "the same text in many documents of one group", "en", "s", 44) for i in (9, 4, 7)] + [(4, "the same text in many documents of one group", "en", "s", 44), (5, "another text", "en", "s", 12), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 4, 5]


def test_a_doc_id_with_two_texts_keeps_no_copy(spark, sf_dir):
    one, other, third = "a text that stands alone under its number", "the copied text of two numbers in this table", "a third text, like none of the others here"
    rows = [(4, one, "en", "s", 1), (4, other, "en", "s", 1), (2, other, "en", "s", 1), (4, third, "en", "t", 1), (6, None, "en", "s", 0), (6, "", None, "s", 0), (7, "", "en", None, 0)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        kept = corpus_pipeline.keep_one_of_each_group(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(4, one), (2, other), (4, third), (6, "")])


def test_empty_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
