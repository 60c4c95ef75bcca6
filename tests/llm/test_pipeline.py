from collections import Counter

import corpus_pipeline
from kinfold.llm import langid, mixing, simhash, spans
from kinfold.llm import queries as llm

D = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stash(stage(spark, docs, D), name)
        assert docs.columns == DOCUMENTS, name
        if name == "language_id":
            assert docs.count() == langid.predict_language(before).where("lang_pred <> 'und' and score >= 0.3").count()
        if name == "simhash_near_dedup":
            classes = {r.component_id for r in simhash.simhash_near_duplicates(before).collect()}
            assert {r.doc_id for r in docs.collect()} == classes and docs.count() == len(classes)
        if name == "span_dedup":
            want = {r.doc_id: r.kept_text for r in spans.remove_repeats(before).collect() if r.kept_text or not r.changed}
            assert {r.doc_id: r.text for r in docs.collect()} == want
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "source_mix":
            times = Counter(r.doc_id for r in docs.collect())
            for r in mixing.mix(before).collect():
                assert times[r.doc_id] == (1 if r.size == 0 else (2 * r.taken + r.size) // (2 * r.size))
    final = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert final.count() == docs.count()


def test_run_and_queries(spark):
    assert corpus_pipeline.run(spark, D).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {n.split("_")[0] for n in llm.queries()} == {f"op{k}" for k in range(1, 11)}


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "Words of some text. " * 3, "en", None, 60)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, D)
        df.collect()
