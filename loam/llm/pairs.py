"""Problem 3: defective question-answer pairs and their defect.

``empty`` and ``copied`` are decided by expressions on normalised text. ``refusal``: openings of answers are clustered by
verified MinHash; a cluster that recurs across unrelated prompts is a template, and one that takes up nothing of its
prompts is a refusal. Templates that name what was asked are refusals where most of their answers also decline by their
wording. Openings too rare to recur are compared with the words of the refusals so found. ``language`` compares the
languages of question and answer under the character models. ``truncated``: an answer without a closing mark breaks off
where its last words hardly ever end a sentence of the corpus, or a bracket, comma, hyphen or opened quotation is left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.clusters import similar_groups
from loam.llm.langid import Identifier
from loam.session import cut_lineage, spread

#: What stands for no answer, reduced to letters and digits.
PLACEHOLDERS = (
    "na", "null", "none", "nonegiven", "tbd", "tba", "todo", "empty", "noanswer", "nil", "nan", "undefined", "unknown", "blank", "notavailable", "notapplicable", "noanswergiven",
    "keineantwort", "keineangabe", "leer", "sansréponse", "pasderéponse", "aucuneréponse", "vide", "sinrespuesta", "vacío", "nessunarisposta", "vuoto", "нетответа", "безответа", "пусто",
)
#: First-person wordings that decline or say that an answer cannot be given, by language; a check on templates
#: that take up words of their prompts.
REFUSALS = (
    # English
    r"\b(?:i|we)(?: a|')?m (?:\w+ )?(?:sorry|unable|not able|not allowed|not permitted|afraid)",
    r"\b(?:i|we) (?:can ?not|can't|could not|couldn't|won't|will not|am unable|was unable|were unable|do not know|don't know|have no (?:answer|idea|information)|would rather not|found nothing|must (?:pass|refuse|decline))",
    r"\bno idea\b", r"\bno answer can be given\b", r"\boutside (?:of )?(?:the topics|what) (?:i|we)\b", r"\bnot something (?:i|we) (?:can|may|am|are)",
    r"^(?:sorry|apologies|unfortunately)\b.{0,60}\b(?:i|we|me|us)\b", r"\bno information about\b", r"^this request is (?:outside|beyond)",
    # German
    r"\b(?:kann|darf|möchte|könnte|will|habe|bin) ich\b.{0,80}\b(?:nicht|keine|nichts|kein)\b", r"\bich (?:kann|darf|möchte|weiß|weiss|könnte|bin|habe)\b.{0,80}\b(?:nicht|keine|nichts|außerstande)\b",
    r"\btut mir (?:sehr )?leid\b", r"\bkeine ahnung\b", r"\bwei(?:ß|ss) ich\b.{0,20}\bnicht\b", r"\bich muss\b.{0,40}\b(?:ablehnen|verweigern|passen)\b",
    # French
    r"\bje (?:suis )?(?:\w+ )?(?:désolé|navré)", r"^désolé", r"\bje ne (?:peux|sais|suis pas en mesure|dispose|veux|puis|saurais)", r"\bje n'ai (?:pas|aucune|rien)", r"\baucune idée\b",
    r"\bje préfère ne pas\b", r"\bje (?:dois|me vois obligé de|suis contraint de) (?:refuser|décliner|m'abstenir)", r"\bje ne suis pas autorisé", r"\bon ne m'autorise pas\b",
    # Spanish
    r"\blo siento\b", r"\bno puedo\b", r"\bno (?:lo )?sé\b", r"\bno estoy (?:autorizad|en (?:condiciones|posición))", r"\bni idea\b", r"\bno tengo (?:respuesta|idea|ni idea|informaci)", r"\bno (?:he encontrado|encontré) (?:nada|información)",
    r"\bno me (?:permiten|está permitid)", r"\b(?:debo|tengo que|he de) (?:rechazar|declinar|negarme|abstenerme|rehusar)",
    # Italian
    r"\bmi (?:di)?spiace\b", r"\bspiacente\b", r"\bnon posso\b", r"\bnon (?:lo )?so\b", r"\bnon sono (?:in grado|autorizzat)", r"\bnon ne ho idea\b", r"\bnon ho (?:idea|una risposta|risposta|informazioni|trovato)\b",
    r"\bnessuna idea\b", r"\bnon mi è (?:permesso|consentito)", r"\bdevo (?:rifiutar|declinare|astenermi)",
    # Russian
    r"\bя не (?:могу|знаю|вправе|имею|нашёл|нашел|нашла)\b", r"^не (?:знаю|могу|имею|вправе)\b", r"^(?:извините|простите|к сожалению)\b.{0,40}\bне\b", r"\bмне не (?:разрешено|позволено)\b", r"\bпонятия не имею\b",
    r"\bотказ(?:ать|аться|ываюсь)\b", r"\bничего не (?:нашёл|нашел|нашла|нашлось|найдено|знаю|могу)\b", r"\bзатрудняюсь\b", r"\bнет (?:ответа|сведений|информации)\b",
)
#: Words of an opening; letters from which on a word of the prompt is masked in it.
OPENING_WORDS, MASKED_LETTERS = 16, 4
#: A cluster recurs from this many prompt families on, if they are at least this share of those that as many prompts drawn
#: at random would have, and none has more than this share of its pairs.
FAMILIES, SPREAD, LARGEST = 3, 0.65, 0.5
#: Share of a template's openings that may take up words of their prompts, and of the answers of others that must decline.
TAKEN_UP, DECLINED = 0.25, 0.5
#: Pairs below which recurrence cannot tell, and by how many nats a word such an opening must be likelier as a refusal.
RARE, LIKELIER = 8, 0.7
#: Bands and hash functions a band for openings as sets of words: a pair of similarity 0.8 is missed 3 times in a million.
OPENING_BANDS, OPENING_ROWS = 24, 4
#: Characters an answer may have beyond the question it copies, the share of characters that may differ, and up to how many
#: of them the JVM compares; questions that allow more are compared in Python.
FRAME, ALTERED, MOST_ALTERED = 20, 0.1, 200
#: Nats a character by which a question's language must beat the next, and an answer's that of its question.
ASKED, GIVEN = 0.2, 0.5
#: Of sentences with the same last words, the share that must end there, by the number of words; how many such must be
#: known to tell; and the numbers of last words looked at.
END_SHARE, KNOWN, LAST = {6: 0.05, 4: 0.05, 3: 0.05, 2: 0.03, 1: 0.01}, 4, (6, 4, 3, 2, 1)
#: An answer of so few words may be a mere phrase. It breaks off only if it is known as the beginning of longer
#: sentences, and by itself fewer than this many times.
PHRASE_WORDS, PHRASE_KNOWN = 5, 3

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:[.,'’\-_/][^\W_]+)*")
_CLOSED = re.compile(r"[.!?。！？؟][\"'»”’)\]]*$")
_OPEN_END = re.compile(r"[,;:(\[–—\-‐/„“«]$|[^\W\d_](?:…|\.{3})$")


def reduced(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def plain_words(text: Column) -> Column:
    """Lower-case words with every number as '#'."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}']+", " "))
    return F.filter(F.split(F.regexp_replace(spaced, r"(?<!\S)[^\s\p{N}]*+\p{N}\S*+", "#"), " "), lambda w: w != "")


def spoken_text(answer: Column) -> Column:
    """An answer for matching wordings: lower case, one apostrophe, quotations left out."""
    straight = F.regexp_replace(F.lower(F.trim(answer)), "[’‘`]", "'")
    return F.trim(F.regexp_replace(straight, '[“„«"][^”“»"]*[”“»"]', " "))


def declines(answer: Column) -> Column:
    # One look for a word's edge at each place of a text, and not one for each wording.
    inside, first = [x[2:] for x in REFUSALS if x.startswith(r"\b")], [x for x in REFUSALS if not x.startswith(r"\b")]
    wordings = "|".join([rf"\b(?:{'|'.join(inside)})", *(f"(?:{x})" for x in first)])
    return F.coalesce(spoken_text(answer).rlike(f"(?U){wordings}"), F.lit(False))


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether at most so many insertions, deletions and substitutions turn one text into the other.

    Row by row over the diagonals that can still do so, in numpy; ends once no diagonal can.
    """
    if abs(len(a) - len(b)) > most:
        return False
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    # Cell k of a row i stands for column i + k - most of the table of distances.
    width, far = 2 * most + 1, most + 1
    steps = np.arange(width)
    padded = np.concatenate([np.zeros(most + 1, np.uint32), codes, np.zeros(most + len(a) + 1, np.uint32)])
    row = np.where(steps >= most, steps - most, far)
    row[np.arange(width) - most > len(b)] = far
    for i, c in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
        over = row + (padded[i : i + width] != c)
        over[:-1] = np.minimum(over[:-1], row[1:] + 1)
        column = steps + (i - most)
        over[(column < 0) | (column > len(b))] = far
        if i <= most:
            over[most - i] = i
        row = np.minimum(np.minimum.accumulate(over - steps) + steps, far)
        row[(column < 0) | (column > len(b))] = far
        if row.min() > most:
            return False
    return bool(row[len(b) - len(a) + most] <= most)


@F.pandas_udf(T.BooleanType())
def _altered_copy(a: pd.Series, q: pd.Series) -> pd.Series:
    """``within_edits`` by a tenth of the question; null where it is not asked for."""
    return pd.Series([None if x is None or y is None else within_edits(x, y, int(ALTERED * len(y))) for x, y in zip(a, q)], dtype=object)


def all_pairs(cases: DataFrame, episodes: DataFrame) -> DataFrame:
    """``pair_kind, pair_id, question, answer`` of both tables; an episode takes its question by case_id, if it has one."""
    asked = cases.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.max("question").alias("question"))
    own = cases.select(F.lit("train_case").alias("pair_kind"), F.col("_id").alias("pair_id"), "question", "answer")
    linked = episodes.select("episode_id", "case_id", "answer").join(asked.withColumnRenamed("_id", "case_id"), "case_id", "left")
    return own.unionByName(linked.select(F.lit("episode").alias("pair_kind"), F.col("episode_id").alias("pair_id"), "question", "answer")).distinct()


def opening_words(question: Column, answer: Column) -> Column:
    """The words of an answer's first sentence; '#' for numbers and '§' for words of the prompt."""
    said = F.slice(plain_words(F.element_at(F.split(F.trim(F.coalesce(answer, F.lit(""))), r"(?<=[.!?…])\s+|\n", 2), 1)), 1, OPENING_WORDS)

    def masked(asked: Column) -> Column:
        return F.transform(said, lambda w: F.when((F.length(w) >= MASKED_LETTERS) & F.array_contains(asked, w), F.lit("§")).otherwise(w))

    # The prompt's words as a variable: as an expression they would be made again for each word of the answer.
    return F.element_at(F.transform(F.array(plain_words(question)), masked), 1)


def family_of(question: Column) -> Column:
    """The family of a prompt: its first word; null without a question."""
    first = F.regexp_extract(F.lower(question), r"[\p{L}\p{N}']+", 0)  # the first of its plain words
    return F.when(question.isNotNull(), F.xxhash64(F.when(first.rlike(r"\p{N}"), F.lit("#")).otherwise(first)))


def templates(openings: DataFrame) -> DataFrame:
    """``bag_id, n, recurs, taken_up``: of each bag of opening words the pairs of its cluster, whether that recurs across
    unrelated prompts, and the share of pairs that take up words of their prompts.

    ``openings`` has ``bag_id, bag, asked, family, taken, foreign`` of each pair. Bags, not pairs, are clustered; words
    taken up and numbers are no part of them, so that openings with other names in the same place link. Answers in
    another language than their question's and pairs without a question do not count for recurrence.
    """
    bags = openings.where(F.size("bag") > 0).groupBy("bag_id").agg(F.first("bag").alias("bag"))
    groups = cut_lineage(similar_groups(bags.select("bag_id", F.transform("bag", lambda w: F.xxhash64(w)).alias("sets")), "bag_id", "sets", OPENING_BANDS, OPENING_ROWS))
    asked = openings.where("not foreign and family is not null and asked >= 0")
    counted = cut_lineage(asked.groupBy("bag_id", "asked", "family").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")))
    # Families a language has in effect, were all of the same size.
    share = counted.groupBy("asked", "family").agg(F.sum("n").alias("n")).groupBy("asked").agg((F.pow(F.sum("n"), 2.0) / F.sum(F.col("n") * F.col("n").cast("double"))).alias("kinds"))
    of_family = counted.join(groups, "bag_id").groupBy("group", "asked", "family").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"))
    of_language = of_family.groupBy("group", "asked").agg(F.sum("n").alias("n"), F.count("*").alias("families"), F.max("n").alias("largest"), F.sum("taken").alias("taken"))
    main = F.max_by(F.struct("asked", "n", "families", "largest"), F.struct("n", "asked"))
    of_group = of_language.groupBy("group").agg(main.alias("m"), F.sum("n").alias("all"), F.sum("taken").alias("taken"))
    told = of_group.select("group", "m.*", "all", "taken").join(share, "asked")  # a row a language
    expected = F.col("kinds") * (1 - F.pow(1 - 1 / F.greatest("kinds", F.lit(1.0001)), F.col("n")))
    recurs = (F.col("families") >= FAMILIES) & (F.col("families") >= SPREAD * expected) & (F.col("largest") <= LARGEST * F.col("n"))
    told = told.select("group", F.col("all").alias("n"), recurs.alias("recurs"), (F.col("taken") / F.col("all")).alias("taken_up"))
    return groups.join(told, "group").select("bag_id", "group", "n", "recurs", "taken_up")


def refusals(openings: DataFrame) -> DataFrame:
    """``bag_id`` of the openings that decline: of templates that take up nothing of their prompts, of templates that do
    and whose answers mostly decline by their wording, and of rare openings with the words of the former.

    ``openings`` as for ``templates``, with ``words`` and ``declines`` as well.
    """
    found = cut_lineage(templates(openings))
    bags = openings.groupBy("bag_id").agg(F.first("words").alias("words"), F.count("*").alias("pairs"), F.sum(F.col("declines").cast("int")).alias("declined"))
    known = bags.join(found, "bag_id", "left").withColumn("recurs", F.coalesce("recurs", F.lit(False)))
    plain = F.col("recurs") & (F.col("taken_up") <= TAKEN_UP)
    known = cut_lineage(known.withColumn("kind", F.when(plain, "refusal").when(F.col("recurs"), "open").when(F.coalesce("n", F.lit(0)) < RARE, "rare").otherwise("answer")))
    wording = known.where("kind = 'open'").groupBy("group").agg((F.sum("declined") / F.sum("pairs")).alias("share")).where(F.col("share") >= DECLINED)
    worded = known.where("kind = 'open'").join(wording, "group", "left_semi").select("bag_id")

    framed = F.concat(F.array(F.lit("^")), "words")
    two = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.concat_ws(" ", F.slice(framed, i, 2)))
    grams = F.array_distinct(F.concat(F.filter("words", lambda w: ~w.isin("#", "§")), two))
    each = known.where("kind <> 'open' and size(words) > 0").select("bag_id", "kind", "pairs", F.size("words").alias("size"), F.explode(grams).alias("gram"))
    said, other = F.sum(F.when(F.col("kind") == "refusal", F.col("pairs")).otherwise(0)), F.sum(F.when(F.col("kind") != "refusal", F.col("pairs")).otherwise(0))
    spoken = each.groupBy("gram").agg(said.alias("yes"), other.alias("no"))
    total = known.where("kind <> 'open'").agg(said.alias("all_yes"), other.alias("all_no"))
    # Others only: a gram that no other opening has says nothing.
    no = F.col("no") - F.col("pairs")
    odds = F.when(F.col("yes") + no > 0, F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 1)) - F.log((no + 0.5) / (F.col("all_no") + 1))).otherwise(0.0)
    scored = each.where("kind = 'rare' and size >= 3").join(spoken, "gram").crossJoin(F.broadcast(total)).groupBy("bag_id").agg(F.avg(odds).alias("score"))
    return known.where("kind = 'refusal'").select("bag_id").unionByName(worded).unionByName(scored.where(F.col("score") >= LIKELIER).select("bag_id"))


def _tail_words(sentence: str) -> list[str]:
    return ["#" if any(c.isdigit() for c in w) else w for w in _WORD.findall(sentence.lower())]


def _grams(words: list[str], end: int) -> list[str]:
    """The last words up to a place, as many as ``LAST`` says, with the sentence's beginning where it is reached."""
    return ["\x01".join((["^"] * k + words)[end : end + k]) for k in LAST]


def _phrase(words: list[str]) -> str:
    return "=" + "\x01".join(words)


def _counted_grams(sentences: list[tuple[list[str], int]]) -> Iterator[pd.DataFrame]:
    """``gram, ends, goes_on`` of sentences, given by their words and how often they occur: each of ``_grams`` at each place."""
    pad = max(LAST)
    flat = [w for words, _ in sentences for w in (*["^"] * pad, *words)]
    numbers: dict[str, int] = {"^": 0}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in flat], np.int64)
    times = np.repeat(np.array([n for _, n in sentences], np.int64), [pad + len(words) for words, _ in sentences])
    at = np.flatnonzero(ids)
    last = np.zeros(len(ids), bool)
    last[np.cumsum([pad + len(words) for words, _ in sentences]) - 1] = True
    last, times = last[at], times[at]
    # Numbers of the runs of k words up to each place: those of the runs a word shorter, with the word before them.
    run = ids
    for k in range(1, pad + 1):
        if k > 1:
            before = np.concatenate([np.zeros(k - 1, np.int64), ids[: len(ids) - k + 1]])
            run = np.unique(run * len(numbers) + before, return_inverse=True)[1]
        if k in LAST:
            _, first, gram = np.unique(run[at], return_index=True, return_inverse=True)
            ends = np.bincount(gram, np.where(last, times, 0)).astype(np.int64)
            goes_on = np.bincount(gram, np.where(last, 0, times)).astype(np.int64)
            yield pd.DataFrame({"gram": ["\x01".join(flat[i - k + 1 : i + 1]) for i in at[first].tolist()], "ends": ends, "goes_on": goes_on})


def sentence_ends(texts: DataFrame, column: str) -> DataFrame:
    """``gram, ends, goes_on``: how often one to six words end a sentence of the texts and how often others follow.

    Only sentences with a closing mark count. Short phrases are counted as well: as whole texts, with a closing mark or
    without, and as beginnings of sentences. Counted within each batch before the shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends: Counter = Counter()
            on: Counter = Counter()
            closed: Counter = Counter()
            for text, n in Counter(pdf[column].dropna().tolist()).items():
                sentences = _SENTENCE.split(text.strip())
                if len(sentences) == 1 and len(whole := _tail_words(text)) <= PHRASE_WORDS:
                    ends[_phrase(whole)] += n
                for sentence in sentences:
                    if _CLOSED.search(sentence.rstrip()):
                        closed[sentence] += n
            listed = [(words, n) for sentence, n in closed.items() if (words := _tail_words(sentence))]
            for words, n in listed:
                for k in range(1, min(PHRASE_WORDS + 1, len(words))):
                    on[_phrase(words[:k])] += n
            keys = list(ends | on)
            yield pd.DataFrame({"gram": keys, "ends": [ends[k] for k in keys], "goes_on": [on[k] for k in keys]})
            if listed:
                yield from _counted_grams(listed)

    counted = spread(texts.select(column)).mapInPandas(run, "gram string, ends bigint, goes_on bigint")
    return counted.groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))


def _profiled(tool: Identifier, texts: pd.Series) -> dict[str, np.ndarray]:
    """``profile`` of texts of which many are the same."""
    places, distinct = pd.factorize(texts.fillna(""))
    return {k: x[places] for k, x in tool.profile(list(distinct)).items()}


def _judge_text(shared, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Language defect, structural break and last words of each pair."""
    tool: Identifier = shared.value
    for pdf in batches:
        asked, given = (_profiled(tool, pdf[c]) for c in ("question", "answer"))
        rows = np.arange(len(pdf))
        known = (asked["words"] >= 3) & (asked["letters"] >= 10) & (asked["margin"] >= ASKED)
        best, wanted = given["language"], asked["language"]
        gap = (given["score"][rows, best] - given["score"][rows, wanted]) / np.maximum(1, given["letters"] + given["words"])
        foreign = known & (given["words"] >= 2) & (given["letters"] >= 8) & (best != wanted) & (gap >= GIVEN)
        broken, grams = [], []
        for answer in pdf["answer"]:
            text = (answer or "").rstrip()
            if not text or _CLOSED.search(text) and not _OPEN_END.search(text):
                broken.append(False)
                grams.append([])
                continue
            sentences = [s for s in _SENTENCE.split(text.strip()) if s.strip()]
            sentence = sentences[-1]
            marks = ("()", "[]", "«»", "„“" if "„" in sentence else "“”")
            opened = any(sentence.count(a) > sentence.count(b) for a, b in marks)
            words = _tail_words(sentence)
            broken.append(bool(_OPEN_END.search(text)) or opened)
            if len(sentences) == 1 and len(words) <= PHRASE_WORDS:
                grams.append([f"0\x02{_phrase(words)}"])
            else:
                grams.append([f"{k}\x02{g}" for k, g in zip(LAST, _grams(words, len(words)))] if words else [])
        yield pdf.drop(columns=["question", "answer"]).assign(asked=np.where(known, wanted, -1), foreign=foreign, broken=broken, grams=grams)


def defective_pairs(cases: DataFrame, episodes: DataFrame, identifier: Identifier) -> DataFrame:
    """``pair_kind, pair_id, defect``: each defective pair once, with its first defect of empty, copied, refusal,
    language, truncated.

    A null or blank answer is empty; a pair without a question (null, or an episode without a known case) is judged by its
    answer alone. Rows without an id are no pair. A pair repeated with other content has the first defect of any of its
    rows. Empty tables give no rows.
    """
    pairs = all_pairs(cases, episodes).where(F.col("pair_id").isNotNull())
    answer, question = reduced(F.col("answer")), reduced(F.col("question"))
    near = F.abs(F.length("a") - F.length("q")) <= ALTERED * F.length("q")
    edits = F.levenshtein("a", "q", MOST_ALTERED)
    contained = F.contains("a", "q") & (F.length(F.replace("a", "q", F.lit(""))) <= FRAME)
    copied = (F.col("q") != "") & (contained | (near & edits.between(F.lit(0), ALTERED * F.length("q"))) | F.coalesce("altered", F.lit(False)))
    long = near & (ALTERED * F.length("q") > MOST_ALTERED) & ~contained & (edits < 0)
    easy = pairs.withColumns({"a": answer, "q": question}).withColumn("altered", _altered_copy(F.when(long, F.col("a")), F.when(long, F.col("q")))).withColumn(
        "easy", F.when((F.col("a") == "") | F.col("a").isin(*PLACEHOLDERS), "empty").when(copied, "copied")
    ).drop("a", "q", "altered")
    # Read many times below, so written once.
    easy = cut_lineage(easy)
    rest = easy.where(F.col("easy").isNull()).drop("easy")

    shared = cases.sparkSession.sparkContext.broadcast(identifier)
    words = opening_words(F.col("question"), F.col("answer"))
    bag = F.sort_array(F.array_distinct(F.filter("words", lambda w: ~w.isin("#", "§"))))
    opened = rest.select("pair_kind", "pair_id", "question", "answer", words.alias("words"), family_of(F.col("question")).alias("family"), declines(F.col("answer")).alias("declines"))
    schema = "pair_kind string, pair_id string, words array<string>, family bigint, declines boolean, asked int, foreign boolean, broken boolean, grams array<string>"
    judged = cut_lineage(spread(opened).mapInPandas(lambda b: _judge_text(shared, b), schema))
    openings = cut_lineage(judged.select("pair_kind", "pair_id", "words", "family", "declines", "asked", "foreign", bag.alias("bag"), F.array_contains("words", "§").cast("int").alias("taken")).withColumn("bag_id", F.xxhash64("bag")))
    # Written, so that the plan of the result does not hold that of the clusters.
    refused = cut_lineage(openings.join(refusals(openings), "bag_id", "left_semi").select("pair_kind", "pair_id"))

    wanted = judged.where(F.size("grams") > 0).select("pair_kind", "pair_id", F.explode("grams").alias("g")).select(
        "pair_kind", "pair_id", F.substring_index("g", "\x02", 1).cast("int").alias("k"), F.substring_index("g", "\x02", -1).alias("gram")
    )
    counted = wanted.join(sentence_ends(rest, "answer"), "gram", "left").withColumns({"ends": F.coalesce("ends", F.lit(0)), "goes_on": F.coalesce("goes_on", F.lit(0))})
    # The longest run of last words that is known well enough tells; a long answer's last word that is not known at all is a part of one.
    known = F.col("ends") + F.col("goes_on")
    share = F.create_map(*[F.lit(x) for pair in END_SHARE.items() for x in pair])[F.col("k")]
    phrase = (F.col("ends") < PHRASE_KNOWN) & (F.col("goes_on") >= KNOWN)
    told = F.when(F.col("k") == 0, F.struct(F.lit(0).alias("order"), phrase.alias("cut"))).when(known >= KNOWN, F.struct((-F.col("k")).alias("order"), (F.col("ends") < share * known).alias("cut")))
    unknown = F.max((F.col("k") == 1) & (known == 0) & F.col("gram").rlike(r"^[\p{L}'’\-]+$"))
    verdict = counted.groupBy("pair_kind", "pair_id").agg(F.min(told).alias("told"), unknown.alias("unknown"))
    cut = verdict.where(F.coalesce(F.col("told.cut"), F.lit(False)) | F.col("unknown")).select("pair_kind", "pair_id")

    rank = lambda df, k: df.select("pair_kind", "pair_id", F.lit(k).alias("rank"))
    names = ("empty", "copied", "refusal", "language", "truncated")
    every = (
        rank(easy.where("easy = 'empty'"), 0)
        .unionByName(rank(easy.where("easy = 'copied'"), 1))
        .unionByName(rank(refused, 2))
        .unionByName(rank(judged.where("foreign"), 3))
        .unionByName(rank(judged.where("broken"), 4))
        .unionByName(rank(cut, 4))
    )
    first = every.groupBy("pair_kind", "pair_id").agg(F.min("rank").alias("rank"))
    return first.select("pair_kind", "pair_id", F.element_at(F.array(*map(F.lit, names)), F.col("rank") + 1).alias("defect"))
