import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from loam.llm.abuse import BUCKETS, CHAR_DIM, STATE, WINDOW, WORD_DIM, Network, Vocabulary, Windows, content_scores, fit, plain_word, source_rates
from loam.llm.abuse_seeds import ABUSIVE, LEXICON, TECHNICAL, _filled, seed_sentences


def test_disguises():
    given = {"V.o.l.l.i.d.i.o.t": "vollidiot", "Wo​men": "women", "fuсk": "fuck", "m3rde": "merde", "f#ck": "f*ck", "Volliddddiot": "vollidiot", "ERR_299": "err_0", "12.5": "", "cachond@": "cachond@", "(pump)": "pump"}
    assert {k: plain_word(k) for k in given} == given


def test_windows_cover_every_word():
    v = Vocabulary()
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(75)) + ". Next one. p i g stops", None, "", "1 2 3"]
    w = Windows(v, texts)
    seen = {k for k in w.rows.reshape(-1).tolist() if k}
    assert {v.words[x] for x in ("waa", "wwc", "next", "pig")} <= seen
    assert len(seen) == 75 + 4
    assert w.rows.shape[1] == WINDOW and set(w.text.tolist()) == {0}


def test_windows_run_over_sentence_ends():
    v = Vocabulary()
    w = Windows(v, ["Mind the gate. The gate is shut. Come in later.", "Alone here."])
    assert w.rows.shape[0] == 5 and w.across.tolist() == [False, False, False, False, True]
    assert w.text.tolist() == [0, 0, 0, 1, 0] and (w.rows[4] > 0).sum() == 10


def test_no_seed_phrase_is_from_the_tables():
    """Frames are of four fixed words at most, and no phrase of five words put together occurs in the test tables."""
    assert all(len(re.sub(r"{.}", " ", f).split()) <= 4 for frames in ABUSIVE.values() for f in frames)
    rng = np.random.default_rng(3)
    frames = [(f, LEXICON[k]) for k in ABUSIVE for f in ABUSIVE[k]] + [(f, TECHNICAL[k]) for k in TECHNICAL for f in ("{V} {O}", "{T}", "{R} {F}")]
    phrases = [_filled(f, words, rng, "abc") for f, words in frames for _ in range(400)]
    words = lambda t: [p for x in t.split() if (p := plain_word(x))]
    fives = {tuple(w[k : k + 5]) for w in map(words, phrases) for k in range(len(w) - 4)}
    for folder in sorted(Path("/root/testdata").glob("sf*")):
        for text in pd.read_parquet(folder / "documents.parquet", columns=["text"])["text"].dropna():
            w = words(text)
            assert not fives.intersection(zip(w, w[1:], w[2:], w[3:], w[4:])), text[:200]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, WORD_DIM + CHAR_DIM)) * 0.5
    rows = np.array([[1, 2, 3, 0], [4, 1, 0, 0], [2, 2, 3, 4]])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g, dx = net.gradients(x, rows, y, weight)

    def slope(array, at):
        keep, out = array[at], []
        for step in (1e-3, -1e-3):
            array[at] = keep + step
            out.append(net.gradients(x, rows, y, weight)[0])
        array[at] = keep
        return (out[0] - out[1]) / 2e-3

    for name in ("wf", "uf", "bf", "wb", "ub", "bb", "att", "v", "out", "b"):
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in net.p[name].shape)
            assert slope(net.p[name], at) == pytest.approx(g[name][at], abs=2e-4), name
    for _ in range(6):
        at = (int(rng.integers(1, 5)), int(rng.integers(0, x.shape[1])))
        assert slope(x, at) == pytest.approx(dx[at], abs=2e-4)
    assert net.p["word"].shape == (BUCKETS, WORD_DIM) and net.p["uf"].shape == (STATE, 3 * STATE)


@pytest.fixture(scope="module")
def classifier():
    plain = [f"The pump at line {i} was checked by the night shift. Nothing unusual was found near the valve." for i in range(60)]
    return fit([(t, 0.0) for t in plain] + [(plain[0] + " You are a pathetic moron.", 1.0)], plain, seeds=3000, steps=360)


def test_held_out_sentences(classifier):
    texts, labels = seed_sentences(600, np.random.default_rng(99))
    score = classifier.score(texts)
    assert ((score > 0.5) == np.array(labels, bool)).mean() > 0.93


def test_table(spark, classifier):
    rows = [(1, "You are a pathetic moron, get lost.", "a", 1), (2, None, "a", 1), (3, " \n", None, 1), (4, "The pump at line 7 was checked by the night shift. " * 3000, "b", 1), (5, "", "b", 1), (1, "You are a pathetic moron, get lost.", "a", 2)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, score INT")
    scored = content_scores(df, classifier)
    got = scored.collect()
    assert len(got) == 6
    assert {r.doc_id for r in got if r.abusive} == {1}
    assert all(r.score == 0 for r in got if r.doc_id in (2, 3, 5))
    rates = {r.source: (r.n_docs, r.n_abusive) for r in source_rates(scored).collect()}
    assert rates == {"a": (3, 2), "b": (2, 0), None: (1, 0)}
    assert content_scores(df.limit(0), classifier).count() == 0


def test_fit_without_reviews():
    assert fit([], [], seeds=400, steps=30).score(["", None]).tolist() == [0, 0]
