"""Labels of words where there are more languages than a byte holds."""

import numpy as np
import pytest

from emberline.llm import langid


@pytest.mark.parametrize("n_lang", [128, 129, 150, 300])
def test_viterbi_of_many_languages(n_lang):
    want = np.repeat([n_lang - 1, 3, n_lang - 10, 127, n_lang - 1], 40)
    scores = np.zeros((len(want), n_lang))
    scores[np.arange(len(want)), want] = 5.0
    assert langid.viterbi(scores, np.array([0, 90, len(want)]), 4.0).tolist() == want.tolist()


def test_viterbi_in_parts_is_the_same():
    rnd = np.random.default_rng(1)
    bounds = np.concatenate([[0], np.cumsum(rnd.integers(0, 400, 30))])
    scores = rnd.normal(size=(bounds[-1], 3))
    whole = langid.viterbi(scores, bounds, 1.5)
    for cells in (1, 20, 10**6):
        assert langid.viterbi_in_parts(scores, bounds, 1.5, cells).tolist() == whole.tolist()


def test_scripts_that_no_language_has(spark):
    rows = [(i, f"the quick brown fox number {i} jumps", "en") for i in range(40)] + [(i, f"der schnelle braune fuchs {i} springt", "de") for i in range(40, 80)]
    rows += [(100, "快速的棕色狐狸", None), (101, "the quick 快速的棕色狐狸跳过懒狗快速的棕色狐狸", None), (102, "12 34", None)]
    out = {r["doc_id"]: r for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[100]["score"] == 0.0 and out[100]["lang_pred"] in ("de", "en") and out[102]["lang_pred"] == "und"
    assert out[101]["lang_pred"] == "en" and 0 < out[101]["score"] < 0.5 and out[3]["score"] == 1.0
