import math
from collections import defaultdict

import numpy as np
import pytest

from kinfold.llm import langid as S

EN = ["the cat and the dog sat on the mat while it rained", "there is nothing that we would like more than this", "some other words of the same kind were written down"]
FR = ["le chat et le chien sont sur la table pendant la pluie", "il y a des choses que nous aimons plus que les autres", "quelques mots de la même sorte sont écrits ici"]
ROWS = [(k, EN[k % 3] + f" {k}", "en", "s", 1.0) for k in range(40)] + [(100 + k, FR[k % 3] + f" {k}", "fr", "s", 1.0) for k in range(40)]
SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double, row int, found string, _language int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2) for r in rows], SCHEMA)


def test_tables_hold_the_code_lengths_of_the_trees(spark):
    trees = S.train(docs(spark, ROWS))
    assert trees.languages == ["en", "fr"]
    for text in ("the cat", "zzz ñandú", "", "x", "le même"):
        codes = S._codes(np.frombuffer(S._padded(text), np.uint8))
        assert np.allclose(trees.bits(codes).sum(axis=0), trees.lengths([text])[0][0], rtol=1e-5, atol=1e-6)


def test_code_lengths_by_definition():
    text = "abracadabra"
    data = S._padded(text)
    trees = S.ContextTrees(["x"], *(lambda c: (c[0], np.zeros(len(c[0]), int), c[1]))(np.unique(S._codes(np.frombuffer(data, np.uint8)), return_counts=True)))
    counts = defaultdict(lambda: defaultdict(int))
    for i in range(3, len(data)):
        for k in range(4):
            counts[data[i - k : i]][data[i]] += 1

    def bits(context, symbol):
        cost = 0.0
        for k in range(3, -1, -1):
            own = counts.get(context[3 - k :])
            if own is None:
                continue
            total, distinct = sum(own.values()), len(own)
            if symbol in own:
                return cost - math.log2(own[symbol] / (total + distinct))
            cost -= math.log2(distinct / (total + distinct))
        return cost + 8

    probe = S._padded("cadaxbra")
    want = sum(bits(probe[i - 3 : i], probe[i]) for i in range(3, len(probe)))
    assert trees.lengths(["cadaxbra"])[0][0, 0] == pytest.approx(want, rel=1e-5)


def test_predictions(spark):
    rows = [*ROWS, (500, "the dog and the rain", None, None, None), (501, None, "en", None, None), (502, "123 -- 45", None, None, None), (503, "", None, None, None), (None, "les mots de la table", "fr", None, None), (500, "the dog and the rain", None, None, None)]
    got = S.predict_language(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[500].lang_pred == "en" and by[None].lang_pred == "fr" and by[None].held_out is False
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (501, 502, 503))
    truth = {r[0]: r[2] for r in ROWS}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_stage_drops_only_unknown(spark):
    rows = [*ROWS, (501, None, "en", "keep", 7.0), (502, "123", None, "keep", 7.0)]
    out = S.reject_unknown(docs(spark, rows))
    assert out.columns == docs(spark, []).columns and out.count() == len(ROWS) and out.where("score = 1.0").count() == len(ROWS)


def test_nothing_to_learn_from(spark):
    assert S.predict_language(docs(spark, [])).count() == 0
    row = S.predict_language(docs(spark, [(1, "some text", None, None, None)])).first()
    assert row.lang_pred == "und"


def test_held_out_accuracy_on_the_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = S.predict_language(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_copies_count_once_and_drop_no_language(spark):
    fr = [(k, FR[k % 2], "fr", "s", 1.0) for k in range(400)]
    en = [(1000 + k, EN[0], "en", "s", 1.0) for k in range(400)] + [(2000 + k, EN[1 + k % 2] + f" {k}", "en", "s", 1.0) for k in range(8)]
    few = S.train(docs(spark, [*fr[:2], en[0], *en[400:]]))
    for sample_docs in (1, 2, 20):
        trees = S.train(docs(spark, fr + en), sample_docs=sample_docs)
        assert trees.languages == ["en", "fr"]
    # 20 places hold all distinct texts, each once.
    for k in range(2):
        assert all(np.array_equal(x, y) for a, b in zip(trees.nodes[k], few.nodes[k], strict=True) for x, y in zip(a, b, strict=True))


def test_a_training_text_counts_whole(spark):
    """What only the end of a very long text holds is learned."""
    rows = [(k, "aa bb " * 20_000 + f"qzqz wxwx {k} " * 50, "xx", None, None) for k in (0, 1, 4)] + [(10 + k, f"mm nn oo {k}", "yy", None, None) for k in range(8)]
    trees = S.train(docs(spark, rows))
    code = S._codes(np.frombuffer(S._padded("qzqz wxwx"), np.uint8))
    assert np.isin(code[3:], trees.nodes[0][S.ORDER][0]).all()
