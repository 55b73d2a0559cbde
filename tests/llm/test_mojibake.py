import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm.charlm import ALPHABET, DISCOUNT, CharModels
from loam.llm import mojibake
from loam.llm.mojibake import CHAINS, fit, fit_on, garble, restore_encoding, undo_chain

LINES = [
    "Die Prüfung der Wellendichtung läuft für den nächsten Monat über das Büro.",
    "Le débitmètre a été remplacé après la visite, la pièce était usée à l'arrêt.",
    "La exportación se cortó según el técnico, la válvula quedó dañada ayer.",
    "После обновления ошибка исчезла, и насос снова в работе без замечаний.",
    "The panel then shows “Seal pressure low” and waits – same as in March.",
    "Il bruciatore è tornato a zero perché il filtro non era più pulito.",
]
TEXTS = [f"{a} {b} Nr. {i}." for i in range(30) for a in LINES for b in (LINES[i % 6], LINES[(i + 1) % 6])]


def slow_kneser_ney(counts, order):
    """Probability of a character after a context, by the plain recursive formula."""
    grams = {n: Counter() for n in range(1, order + 1)}
    for word, k in counts.items():
        w = f" {word} "
        for n in range(1, order + 1):
            for i in range(max(n - 1, 1), len(w)):
                grams[n][w[i - n + 1 : i + 1], i == n - 1] += k
    table = {n: Counter() for n in grams}
    for n in grams:
        for (g, starts), k in grams[n].items():
            if n == order or (starts and n > 1):
                table[n][g] = max(table[n][g], k) if n < order else table[n][g] + k
    for n in range(1, order):
        before = {}
        for (g, _), _k in grams[n + 1].items():
            before.setdefault(g[1:], set()).add(g[0])
        for g in {g for g, _ in grams[n]}:
            if n == 1 or not any(s for (h, s) in grams[n] if h == g):
                table[n][g] = max(1, len(before.get(g, ())))

    def p(context, c):
        if not context:
            total = sum(table[1].values())
            return max(table[1][c] - DISCOUNT, 0) / total + DISCOUNT * len(table[1]) / total / ALPHABET
        n = len(context) + 1
        same = {g: k for g, k in table[n].items() if g[:-1] == context}
        if not same:
            return p(context[1:], c)
        mass = sum(same.values())
        return max(same.get(context + c, 0) - DISCOUNT, 0) / mass + DISCOUNT * len(same) / mass * p(context[1:], c)

    def score(word):
        w = f" {word} "
        return sum(math.log(p(w[max(0, i - order + 1) : i], w[i])) for i in range(1, len(w)))

    return score


def test_model_equals_the_plain_formula():
    counts = {"anna": 3.0, "hanna": 1.0, "banane": 2.0, "nab": 1.0}
    for order in (2, 3, 4):
        models = CharModels({"x": counts, "y": {"zebra": 1.0}}, order)
        slow = slow_kneser_ney(counts, order)
        words = ["anna", "banana", "hab", "q", "nan", "zzz", ""]
        assert np.allclose(models.score(words)[:, 0], [slow(w) for w in words], atol=1e-4)


@pytest.mark.parametrize("chain", CHAINS, ids=str)
def test_chains_undo_what_they_do(chain):
    for word in ("für", "после", "débitmètre", "“ja”"):
        turned = garble(word, chain)
        if "?" not in turned and turned != word:
            assert undo_chain(turned, chain) == word


def test_finds_and_restores():
    fixer = fit(TEXTS)
    assert sum(gain >= fixer.margin for gain, _ in fixer.find(TEXTS)) == 0
    for chain in (CHAINS[0], (("utf-8", "cp1251"),), (("cp1251", "cp1252"),), (("koi8-r", "cp1251"),), CHAINS[-3]):
        for line in LINES:
            turned = garble(line, chain)
            if turned == line or "?" in turned:
                continue
            [(gain, hits)] = fixer.find([turned])
            assert gain >= fixer.margin, (chain, turned)
            assert fixer.repair(turned, hits)[0] == line


def test_table(spark):
    fixer = fit(TEXTS)
    good, bad = LINES[0], garble(LINES[1], CHAINS[0])
    rows = [(1, good, "x"), (2, bad, "x"), (2, bad, "y"), (3, None, "x"), (4, "", "x"), (5, "plain text?", "x"), (6, "Pr�fung", "x"), (7, "Zeigt der Export “Ã¶” statt “ö”, ist er falsch.", "x"), (8, "x" * 100_000, "x")]
    df = spark.createDataFrame(rows, "chunk_id BIGINT, text STRING, restored STRING")
    got = {r.chunk_id: r for r in restore_encoding(df, fixer).collect()}
    assert set(got) == {2, 6}
    assert got[2].restored == LINES[1] and got[2].recoverable
    assert not got[6].recoverable
    assert restore_encoding(df.limit(0), fixer).count() == 0
    assert restore_encoding(df.limit(0)).count() == 0


def test_models_of_all_rows(spark):
    rare = "Übergrößenträger"
    ids = spark.range(30_000).withColumn("seen", F.pmod(F.xxhash64("id"), F.lit(30_000 // 8_000)) == 0)
    df = ids.select(F.col("id").alias("chunk_id"), F.when(~F.col("seen") & (F.col("id") % 10 == 0), rare).otherwise("plain words of each day").alias("text"))
    fixer = fit_on(df)
    assert fixer.models.score([rare])[0, 0] > -1.5 * len(rare)
    assert fixer.find([rare])[0][0] < fixer.margin


def test_table_fit_finds_and_restores(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(9_000 + k, garble(line, (("utf-8", "cp1251"),))) for k, line in enumerate(LINES)]
    df = spark.createDataFrame(rows, "chunk_id BIGINT, text STRING")
    got = {r.chunk_id: r.restored for r in restore_encoding(df).collect()}
    assert got == {9_000 + k: line for k, line in enumerate(LINES)}


def test_long_codes_do_not_make_the_model_large(spark):
    """F1: the model has what can be asked of it, with the scores that a model of all n-grams gives."""
    rng = np.random.default_rng(5)
    codes = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEF+/"), 20_000)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(TEXTS + codes + ["Zeigt\u00a0für die\u00a0Prüfung", "x “ö”.é wie?so"])]
    fixer = fit_on(spark.createDataFrame(rows, "chunk_id BIGINT, text STRING"))
    assert sum(len(k) for k in fixer.models.keys.values()) < 20_000
    whole = CharModels({"clean": Counter(w for _, t in rows for w in t.translate(str.maketrans("123456789", "0" * 9)).split())})
    words = {w for _, t in rows for w in t.split() if not w.isascii() or "?" in w} | {"Zeigt\u00a0für", ".é"}
    asked = sorted(words | {x for w in words for chain in CHAINS if (x := undo_chain(w, chain)) is not None})
    assert np.allclose(fixer.models.score(asked), whole.score(asked), atol=1e-4)


def test_all_rows_make_the_model_and_the_margin(spark, monkeypatch):
    """no row is left out of the model, and each clean row's gain is among those that the margin is taken from."""
    rare = "Übergrößenträger"
    ids = spark.range(4_000).withColumn("rare", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0)
    df = ids.select(F.col("id").alias("chunk_id"), F.when(F.col("rare"), rare).when(F.col("id") % 2 == 0, "tägliche Prüfung").otherwise("plain words").alias("text"))
    seen = []
    monkeypatch.setattr(mojibake, "_margin", lambda gains, *rest: seen.append(gains) or mojibake.LEAST_MARGIN)
    fixer = fit_on(df)
    assert fixer.models.score([rare])[0, 0] > -0.5 * len(rare)
    assert sum(seen[0].values()) == 4_000


def test_numbered_tokens_are_the_listed_ones():
    """tokens numbered for a block of texts are those that each text has."""
    from loam.llm.mojibake import _listed, _numbered

    for texts in (["é a\xa0b ü, plain", "", "plain only", " “é” Ã© \x85x é é\n", "ж"], ["a\x01é\x1fü b", "é"], []):
        tokens, sizes, places = _numbered(texts)
        ends = np.cumsum(sizes)
        assert [[tokens[k] for k in places[e - n : e]] for n, e in zip(sizes, ends)] == _listed(texts)
