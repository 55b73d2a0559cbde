import random
from collections import Counter

import pytest

from loam.llm.clusters import shingles, similar_groups
from loam.llm.langid import fit
from loam.llm import pairs, queries
from loam.llm.pairs import declines, defective_pairs, plain_words, within_edits
from pyspark.sql import functions as F
from test_langid import WORDS, sentence

CASES = "_id STRING, question STRING, answer STRING, source STRING, defect STRING"
EPISODES = "episode_id STRING, case_id STRING, answer STRING, done BOOLEAN"


@pytest.fixture(scope="module")
def identifier():
    rng = random.Random(1)
    return fit([(x, " ".join(sentence(rng, x) for _ in range(3))) for x in list(WORDS) * 150])


def test_defects(spark, identifier):
    rng = random.Random(5)
    fine = [(f"f{i}", f"{'What How Why When'.split()[i % 4]} {sentence(rng, 'en', 7)[:-1].lower()}?", f"The valve at line {i} was opened by the night shift on purpose.", None, None) for i in range(60)]
    ask = "How was the pump checked by the night shift?"
    cases = fine + [
        ("e1", ask, None, "x", None), ("e2", ask, " ​\n", "x", None), ("e3", ask, "N/A", "x", None), ("e4", ask, "—", None, None),
        ("c1", ask, "You asked: HOW WAS THE PUMP CHECKED BY THE NIGHT SHIFT", None, None), ("c2", ask, "how  was the pump  checked by the night shift.", None, None),
        ("c3", "why " * 12_000, "Why " * 11_990 + "who who", None, None), ("ok6", "why " * 12_000, "The valve at line 9 was opened by the night shift on purpose. " * 800, None, None),
        ("r1", ask, "I'm sorry, but I can't help with that.", None, None), ("r2", ask, "Es tut mir leid, dabei kann ich nicht helfen.", None, None), ("r3", ask, "Понятия не имею.", None, None),
        ("l1", ask, sentence(rng, "de", 10), None, None), ("l2", ask, sentence(rng, "ru", 10), None, None),
        ("t1", ask, "The valve at line 3 was opened by the night", None, None), ("t2", ask, "The valve at line 3 was opened by the night sh", None, None), ("t3", ask, "The valve at line 3 was opened (by", None, None), ("t4", ask, "The valve at line 3 was ope-", None, None),
        ("ok1", ask, "The valve at line 3 was opened by the night shift on purpose", None, None), ("ok2", ask, "ERR_4", None, None), ("ok3", ask, "No", None, None), ("ok4", None, "The night shift", None, None),
        ("ok5", ask, "The pump cannot start while the guard is open, so close it first.", None, None), (None, ask, None, None, None), ("e1", ask, None, "x", None),
    ]
    # Refusals show by recurring over prompts that begin otherwise.
    said = {"en": "I'm sorry, but I can't help with that.", "de": "Es tut mir leid, dabei kann ich nicht helfen.", "ru": "Понятия не имею.", "fr": "Je ne sais pas."}
    cases += [(f"r{lang}{k}", f"{first} {sentence(rng, lang, 9)[:-1].lower()}?", text, None, None) for lang, text in said.items() for k, first in enumerate(WORDS[lang][:6])]
    episodes = [("p1", "c1", "", True), ("p2", None, "Je ne sais pas.", True), ("p3", None, sentence(rng, "it", 8), True), ("p4", "no such", "Section 5.1", True), ("p5", "f1", sentence(rng, "fr", 8), None), ("p5", "f1", sentence(rng, "fr", 8), None)]
    df, ep = spark.createDataFrame(cases, CASES), spark.createDataFrame(episodes, EPISODES)
    got = defective_pairs(df, ep, identifier).collect()
    found = {r.pair_id: r.defect for r in got}
    assert len(found) == len(got)
    names = {"e": "empty", "c": "copied", "r": "refusal", "l": "language", "t": "truncated"}
    want = {c[0]: names[c[0][0]] for c in cases if c[0] and c[0][0] in names} | {"p1": "empty", "p2": "refusal", "p5": "language"}
    assert found == want
    assert defective_pairs(df.limit(0), ep.limit(0), identifier).count() == 0


def test_refusals_without_known_wording(spark, identifier):
    """An opening that recurs over unrelated prompts declines in whatever words; one that serves one kind of prompt answers
    it; one that takes up the prompt's words declines only where the wording says so."""
    firsts = "What How Why When Where Who Which Does".split()
    names = "pump valve motor filter panel gauge sensor relay".split()
    ask = lambda f, n: f"{f} is the {n} checked by the night shift?"
    rows = []
    for k, (f, n) in enumerate(zip(firsts, names)):
        rows += [(f"ra{k}", ask(f, n), "Zork blims the quandary today."), (f"ok{k}", ask("Where", n), "Find it beside the big red door."), (f"okb{k}", ask(f, n), f"First look whether the {n} runs hot and dry.")]
        rows += [(f"rc{k}", ask(f, n), f"Giving advice on the {n} is not something I can do here.")]
    rows += [("rare", ask("Who", "pump"), "Zork blims the whole quandary, says the boss today."), ("okr", ask("Who", "pump"), "Ada opened it at noon.")]
    cases = spark.createDataFrame([(*r, None, None) for r in rows], CASES)
    got = {r.pair_id: r.defect for r in defective_pairs(cases, spark.createDataFrame([], EPISODES), identifier).collect()}
    assert got == {r[0]: "refusal" for r in rows if r[0].startswith("r")}


def test_the_question_over_again(spark, identifier):
    ask = "How was the pump checked by the night shift?"
    rows = [("twice", ask, f"{ask}\n{ask}", None, None), ("thrice", ask, f"You ask: {ask} {ask} {ask}", None, None), ("ok", ask, f"{ask} By hand, with the long gauge, twice a day. {ask}", None, None)]
    got = {r.pair_id: r.defect for r in defective_pairs(spark.createDataFrame(rows, CASES), spark.createDataFrame([], EPISODES), identifier).collect()}
    assert got == {"twice": "copied", "thrice": "copied"}


def test_wordings(spark):
    rows = [("I cannot answer this.", True), ("The relief valve cannot start.", False), ("I would check the pump first: sorry sight as it is.", False), ("It is not allowed to run it.", False),
            ("The panel shows “Sorry, I can't”.", False), (None, False), ("Ich kann dazu leider nichts sagen.", True), ("К сожалению, я не могу помочь.", True)]
    df = spark.createDataFrame(rows, "answer STRING, want BOOLEAN")
    assert df.where(declines(F.col("answer")) != F.col("want")).count() == 0


def test_groups_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        base = [rng.choice("abcdefghijklmnop") * 3 for _ in range(40)]
        for j in range(3):
            words = base.copy()
            if j:
                words[rng.choice((0, 39))] = f"w{i}{j}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "id BIGINT, text STRING").select("id", shingles(plain_words(F.col("text"))).alias("s"))
    sets = {r.id: set(r.s) for r in df.collect()}
    group = {r.id: r.group for r in similar_groups(df, "id", "s").collect()}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert group == root


def test_openings_one_word_apart_are_one_template(spark, identifier):
    asks = ["How was the pump checked?", "Who opened the relief valve?", "When does the filter run dry?", "Where is the seal kept?", "Why did the motor stop?"]
    verbs = ["cannot", "can't", "won't", "shan't", "will not"]
    cases = [(f"a{k}", ask, f"I {verb} give that away and so this line stays empty for you here.", None, None) for k, (ask, verb) in enumerate(zip(asks, verbs))]
    got = {r.pair_id: r.defect for r in defective_pairs(spark.createDataFrame(cases, CASES), spark.createDataFrame([], EPISODES), identifier).collect()}
    assert got == {f"a{k}": "refusal" for k in range(5)}


def test_bucket_members_meet_without_their_leader(spark):
    rows = [(k, [1, 2, *range(10 * k, 10 * k + 8)]) for k in range(1, 5)] + [(7, [1, 2, *range(20, 27), 99])]
    df = spark.createDataFrame(rows, "id BIGINT, s ARRAY<BIGINT>")
    group = {r.id: r.group for r in similar_groups(df, "id", "s", 400, 1).collect()}
    assert group == {1: 1, 2: 2, 3: 3, 4: 4, 7: 2}


def test_long_copies_by_the_same_rule(spark, identifier):
    rng = random.Random(3)
    ask = "".join(rng.choice("abcdefgh") for _ in range(4_000))
    turned = lambda n: "".join("z" if k % 10 == 0 and k < 10 * n else c for k, c in enumerate(ask))
    cases = [("copy", ask, turned(390), None, None), ("other", ask, turned(400) + "zz", None, None)]
    got = {r.pair_id: r.defect for r in defective_pairs(spark.createDataFrame(cases, CASES), spark.createDataFrame([], EPISODES), identifier).collect()}
    assert got.get("copy") == "copied" and got.get("other") != "copied"


def test_within_edits():
    rng = random.Random(4)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            now = [i]
            for j, d in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
            row = now
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("abя") for _ in range(rng.randrange(12))) for _ in range(2))
        for most in range(6):
            assert within_edits(a, b, most) == (slow(a, b) <= most), (a, b, most)


def test_language_models_as_for_chunks(monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "table", lambda s, d, name: name)
    monkeypatch.setattr(queries, "fitted", lambda name, fit, *tables: seen.append((name, fit, tables)))
    monkeypatch.setattr(queries, "defective_pairs", lambda *x: None)
    monkeypatch.setattr(queries, "passage_languages", lambda *x: None)
    queries.p3_found(None, "")
    queries.p2_passages(None, "")
    assert seen == [("languages", queries.fit_on, ("chunks",))] * 2


def test_words_of_a_prompt_are_made_once(spark):
    """and not for each word of the answer's opening; a family is the first of them."""
    rows = [("How was valve V-12 checked?", "The valve V-12 was checked 3 times. Then the valve was shut."), (" … Ça ira, l'été?", "Oui, l'été ira"), ("¿12 o 13?", "No."), ("", ""), (None, "Fine."), ("—", None)]
    df = spark.createDataFrame(rows, "question STRING, answer STRING")
    got = df.select(pairs.opening_words(F.col("question"), F.col("answer")).alias("words"), pairs.family_of(F.col("question")).alias("family"), F.xxhash64(F.element_at(F.concat(plain_words(F.col("question")), F.array(F.lit(""))), 1)).alias("first"))
    found = got.collect()
    assert found[0].words == ["the", "§", "v", "#", "was", "§", "#", "times"] and found[1].words == ["oui", "§", "ira"]
    assert [r.family for r in found] == [r.first if q is not None else None for r, (q, _) in zip(found, rows)]
    for plan in (got._jdf.queryExecution().analyzed().toString(), got._jdf.queryExecution().optimizedPlan().toString()):
        assert "array_contains(lambda" in plan and "array_contains(filter" not in plan


def test_ends_of_sentences_against_a_count_one_by_one(spark):
    """texts and sentences that recur are counted at once."""
    rng = random.Random(7)
    texts = [" ".join(sentence(rng, rng.choice(["en", "ru"]), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    texts = [*texts * 3, "Yes", "Yes", "Yes.", "a 12 b 13.", "no end", "", " \n", "^ # ok.", None, "One.\nTwo three!\n"]
    ends, on = Counter(), Counter()
    for text in texts:
        sentences = pairs._SENTENCE.split(text.strip()) if text is not None else []
        if len(sentences) == 1 and len(words := pairs._tail_words(text)) <= pairs.PHRASE_WORDS:
            ends[pairs._phrase(words)] += 1
        for words in (pairs._tail_words(x) for x in sentences if pairs._CLOSED.search(x.rstrip())):
            on.update(pairs._phrase(words[:k]) for k in range(1, min(pairs.PHRASE_WORDS + 1, len(words))))
            for k in range(1, len(words)):
                on.update(pairs._grams(words, k))
            ends.update(pairs._grams(words, len(words)) if words else [])
    got = pairs.sentence_ends(spark.createDataFrame([(t,) for t in texts], "text STRING"), "text").collect()
    assert {r.gram: (r.ends, r.goes_on) for r in got} == {g: (ends[g], on[g]) for g in ends | on} and len(got) == len(ends | on)
    one = [w.split() for w in ("the pump ran", "the pump ran hot")]
    counted = {g: (e, o) for part in pairs._counted_grams([(one[0], 2), (one[1], 1)]) for g, e, o in part.itertuples(index=False)}
    assert counted["ran"] == (2, 1) and counted["pump\x01ran\x01hot"] == (1, 0) and counted["^\x01the\x01pump"] == (0, 3)
