"""Problem 5: text decoded by the wrong encoding, found and restored by character models.

Only tokens with characters outside ASCII, and tokens with a replacement mark inside, can be affected. Each distinct one
is scored by a Kneser-Ney character model as it stands and as every encode-decode chain would have it; the likeliest
chain is taken where it beats the token as it stands by a margin, and a record counts as affected where its tokens
together beat the validated margin. What a replacement mark has taken is found, but cannot be restored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain as joined
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.charlm import CharModels
from loam.llm.charsums import asked_of, less, models_of, sums_of
from loam.session import cut_lineage, spread

#: Encodings that a text may have been in, and those it may have been read as.
WRITTEN = ("utf-8", "cp1251", "koi8-r", "cp866", "cp1252", "mac-roman", "cp850", "iso8859-5", "mac-cyrillic", "cp1250")
READ_AS = ("cp1252", "cp1251", "koi8-r", "cp866", "mac-roman", "cp437", "cp850", "iso8859-5", "mac-cyrillic", "cp1250")
#: Gain in log probability below which a token stands as it is, and below which a record does; the second is the least
#: that ``validate_margin`` may choose.
TOKEN_MARGIN, LEAST_MARGIN = 4.0, 6.0
#: Distinct tokens a worker remembers, and those that are judged beforehand for all workers: both only save time.
MEMO, BEFOREHAND = 300_000, 50_000
ORDER = 5

_TOKEN = re.compile(r"(?<![^\x00-\x20])[\x21-\x7f]*+[^\x00-\x7f][^\x00-\x20]*")
_CONTROL = re.compile(r"[\x00-\x1f]")
_RARE_BLANKS = re.compile(r"[\x1c-\x1f]+")
_BLANK = bytes(max(b, 0x20) for b in range(256))
_HIGH = re.compile(r"[^\x00-\x7f]+")
#: A few characters in quotation marks are spoken about, not part of the text.
_SPOKEN = re.compile(r"[“„\"«'‘`](?<!\S.)\s?[^\w\s]?[^\x00-\x7f]{1,6}[^\w\s]?\s?[”“\"»'’`](?=[\s.,;:!?)]|$)")
_LOST = re.compile(r"(?<!\S)\S*[^\W\d_]\?[^\W\d_]\S*|(?<!\S)\?{2,}(?!\S)")
_MAY_LOSE = re.compile(r"\?(?:\?|(?<=[^\W\d_]\?)[^\W\d_])")  # in every match of the one before
_LONE, _CYRILLIC = re.compile(r"^\W*[Ѐ-ӿ]\W*$"), re.compile(r"[Ѐ-ӿ]{2}")
_DIGITS = str.maketrans("123456789", "000000000")


def _decode_table(name: str) -> str:
    """The 256 characters of an encoding; bytes it leaves undefined stand for the control character of their number."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


_TO_BYTE = {name: {c: b for b, c in enumerate(_decode_table(name))} for name in READ_AS}
for _c in range(0x80, 0xA0):
    _TO_BYTE["cp1252"].setdefault(chr(_c), _c)
_FROM_BYTE = {name: _decode_table(name) for name in WRITTEN if name != "utf-8"}


def undo(token: str, written: str, read_as: str) -> str | None:
    """The token as it was if it had been written and read like that; None where that cannot be."""
    table = _TO_BYTE[read_as]
    if written == "utf-8":
        changed = False

        def run(m: re.Match) -> str:
            nonlocal changed
            s = m.group()
            try:
                out = bytes([table[c] for c in s]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                if s[-1] == "Ã" and read_as == "cp1252":  # its second byte, a hard space, was taken for a blank
                    try:
                        out = bytes([table[c] for c in s + "\xa0"]).decode("utf-8")
                    except (KeyError, UnicodeDecodeError):
                        return s
                else:
                    return s
            changed = True
            return out

        out = _HIGH.sub(run, token)
        return out if changed else None
    back = _FROM_BYTE[written]
    try:
        return "".join(c if c < "\x80" else back[table[c]] for c in token)
    except KeyError:
        return None


def chains() -> list[tuple[tuple[str, str], ...]]:
    """Every single chain, then the double ones of UTF-8, which files saved twice show."""
    single = [((w, r),) for w in WRITTEN for r in READ_AS if w != r]
    return single + [(("utf-8", r), ("utf-8", r)) for r in ("cp1252", "cp1251", "mac-roman")]


CHAINS = chains()
#: Per assumed encoding the characters outside ASCII that it has, and its single chains of one byte a character, as tables.
_HAS = {r: frozenset(c for c in table if c >= "\x80") for r, table in _TO_BYTE.items()}
_BACK = {(w, r): {ord(c): back[b] for c, b in _TO_BYTE[r].items() if c >= "\x80"} for w, back in _FROM_BYTE.items() for r in READ_AS}


def undo_chain(token: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for written, read_as in chain:
        if (token := undo(token, written, read_as)) is None:
            return None
    return token


def _undone(token: str) -> Iterator[tuple[int, str]]:
    """The chains' numbers with what ``undo_chain`` makes of the token, where it can."""
    high = {c for c in token if c >= "\x80"}
    can = {r for r, has in _HAS.items() if high <= has}
    for c, chain in enumerate(CHAINS):
        if len(chain) == 1 and chain[0] in _BACK:
            if chain[0][1] in can:
                yield c, token.translate(_BACK[chain[0]])
        elif (fixed := undo_chain(token, chain)) is not None:
            yield c, fixed


def _readings(token: str) -> list[tuple[int, str]]:
    """What ``_undone`` gives that is printable and another token."""
    return [(c, fixed) for c, fixed in _undone(token) if fixed != token and fixed.isprintable()]


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """The opposite of ``undo_chain``, for tests and validation: characters an encoding lacks become '?'."""
    for written, read_as in reversed(chain):
        table = _decode_table(read_as)
        text = "".join(table[b] for b in text.encode(written, "replace"))
    return text


def _listed(texts: list[str]) -> list[list[str]]:
    """Per text its tokens with characters outside ASCII, without what is only spoken about."""
    return [[] if t.isascii() else _high_tokens(_SPOKEN.sub(" ", t) if _SPOKEN.search(t) else t) for t in texts]


def _numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``_listed`` as distinct tokens, how many tokens each text has, and which."""
    plain = [_SPOKEN.sub(" ", t) if not t.isascii() and _SPOKEN.search(t) else t for t in texts]
    lists = pc.ascii_split_whitespace(pa.array([t.encode("utf-8", "replace") for t in plain], pa.large_string()))
    flat = lists.flatten()
    high = pc.invert(pc.string_is_ascii(flat))
    encoded = flat.filter(high).dictionary_encode()
    tokens = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if any(map(_CONTROL.search, tokens)):  # blanks too
        listed = _listed(texts)
        number = {t: n for n, t in enumerate(dict.fromkeys(joined.from_iterable(listed)))}
        return list(number), np.array(list(map(len, listed)), np.int64), np.fromiter(map(number.__getitem__, joined.from_iterable(listed)), np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    return tokens, np.bincount(text[high.to_numpy(zero_copy_only=False)], minlength=len(texts)), encoded.indices.to_numpy()


def _high_tokens(text: str) -> list[str]:
    """``_TOKEN.findall``, in less time."""
    return [b.decode("utf-8", "surrogatepass") for b in text.encode("utf-8", "surrogatepass").translate(_BLANK).split() if not b.isascii()]


class Repairer:
    """Models and margins; finds and restores the garbled tokens of texts, remembering tokens it has judged.

    ``judged`` may hold what ``judge`` gives for some tokens, so that not every worker judges them.
    """

    def __init__(self, models: CharModels, margin: float = LEAST_MARGIN, judged: dict[str, tuple[float, int] | None] | None = None):
        self.models, self.margin, self.judged = models, margin, judged or {}
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, tuple[float, int, str] | None] = {}
        self.turned: set[str] = set()  # those of the memo that do not stand

    def __getstate__(self) -> dict:
        return {"models": self.models, "margin": self.margin, "judged": self.judged}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def judge(self, tokens: list[str], undone: Callable[[str], list[tuple[int, str]]] = _readings) -> list[tuple[float, int] | None]:
        """Per token, its digits being noughts, its gain and chain, or None where it stands; ``undone`` gives ``_readings``."""
        before = self.models.score(tokens)[:, 0]
        owner, which, restored = [], [], []
        for k, t in enumerate(tokens):
            # A token that the model finds as likely as usual words needs no chain tried.
            if before[k] < -1.5 * (len(t) + 1):
                for c, fixed in undone(t):
                    owner.append(k)
                    which.append(c)
                    restored.append(fixed)
        out: list[tuple[float, int] | None] = [None] * len(tokens)
        if owner:
            gain = self.models.score(restored)[:, 0] - before[owner]
            for i in np.lexsort((-np.array(which), np.round(gain, 3))):  # of equal gains the first chain
                if gain[i] > TOKEN_MARGIN:
                    out[owner[i]] = (float(gain[i]), which[i])
        return out

    def _judge(self, tokens: set[str]) -> None:
        """Fill the memo for new tokens: gain, chain and restored token, or None for tokens that stand."""
        if len(self.memo) > MEMO:
            self._reset()
        new = {t: t.translate(_DIGITS) for t in tokens.difference(self.memo)}
        open_ = [t for t in dict.fromkeys(new.values()) if t not in self.judged]
        found = dict(zip(open_, self.judge(open_))) if open_ else {}
        for t, plain in new.items():
            hit = found[plain] if plain in found else self.judged[plain]
            self.memo[t] = hit and (*hit, undo_chain(t, CHAINS[hit[1]]))
            if hit:
                self.turned.add(t)

    def lost(self, text: str) -> bool:
        """Whether replacement marks stand for characters: U+FFFD, or '?' where the model expects a letter."""
        if "�" in text and "�" in _SPOKEN.sub(" ", text):
            return True
        if not _MAY_LOSE.search(text):
            return False
        for m in _LOST.finditer(text):
            token = m.group()
            if token.strip("?") == "":
                return True
            options = [token.replace("?", c) for c in "éèàêîôçùüöäßóíáñúìò"]
            scores = self.models.score([token, *options])[:, 0]
            if scores[1:].max() > max(scores[0] + self.margin, -2.0 * (len(token) + 1)):
                return True
        return False

    def find(self, texts: list[str]) -> list[tuple[float, dict[str, tuple[float, int, str]]]]:
        """Per text the summed gain and the garbled tokens with their restored forms; (0, {}) where it stands."""
        out: list[tuple[float, dict[str, tuple[float, int, str]]]] = [(0.0, {}) for _ in texts]
        for i, found in self._turned_of(*_numbered(texts)):
            out[i] = found
        return out

    def weigh(self, listed: list[list[str]]) -> list[tuple[float, dict[str, tuple[float, int, str]]]]:
        """``find`` for texts that are given by their tokens."""
        if not listed:
            return []
        self._judge(set().union(*listed))
        out, get = [], self.memo.get
        for tokens in listed:
            if self.turned.isdisjoint(tokens):
                out.append((0.0, {}))
                continue
            hits = {t: h for t in tokens if (h := get(t)) is not None}
            if hits and all(_LONE.match(t) for t in hits) and any(_CYRILLIC.search(t) for t in tokens if t not in hits):
                hits = {}  # a lone letter of the text's own script is an unusual word at most
            out.append((sum(hits[t][0] for t in tokens if t in hits), hits) if hits else (0.0, {}))
        return out

    def _turned_of(self, tokens: list[str], sizes: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, tuple[float, dict[str, tuple[float, int, str]]]]]:
        """What ``weigh`` says of those of the texts, given by ``_numbered``, that have a token that does not stand."""
        self._judge(set(tokens))
        turned = np.array([t in self.turned for t in tokens], bool)
        ends = np.cumsum(sizes)
        at = np.unique(np.searchsorted(ends, np.flatnonzero(turned[places]), side="right")).tolist()
        return zip(at, self.weigh([[tokens[k] for k in places[ends[i] - sizes[i] : ends[i]].tolist()] for i in at]))

    def gains_of(self, tokens: list[str], sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes))
        for i, (gain, _) in self._turned_of(tokens, sizes, places):
            out[i] = gain
        return out

    def repair(self, text: str, hits: dict[str, tuple[float, int, str]]) -> tuple[str, list[int]]:
        """The text with its garbled tokens restored, under the chain that explains most of the text where it can."""
        votes: Counter = Counter()
        for gain, chain, _ in hits.values():
            votes[chain] += gain
        order = [c for c, _ in votes.most_common()]
        used: Counter = Counter()
        tokens = _TOKEN.findall(text)
        # Where most tokens are garbled, short ones that the model takes either way follow the rest.
        mostly = sum(t in hits for t in tokens) > 0.6 * len(tokens)

        def fix(m: re.Match) -> str:
            token = m.group()
            if token not in hits:
                other = undo_chain(token, CHAINS[order[0]]) if mostly and len(token) <= 3 else None
                return other if other is not None and other.isprintable() else token
            gain, chain, best = hits[token]
            if chain != order[0]:
                other = undo_chain(token, CHAINS[order[0]])
                if other is not None and other.isprintable():
                    scores = self.models.score([other.translate(_DIGITS), best.translate(_DIGITS)])[:, 0]
                    if scores[0] >= scores[1] - TOKEN_MARGIN:
                        chain, best = order[0], other
                if chain != order[0] and gain < 2 * LEAST_MARGIN:
                    return token
            used[chain] += 1
            return best

        return _TOKEN.sub(fix, text), [c for c, _ in used.most_common()]


def _token_counts(texts: Iterable[str]) -> Counter:
    counts: Counter = Counter()
    for text in texts:
        counts.update(text.translate(_DIGITS).split())
    return counts


def _reads_as_utf8(token: str) -> bool:
    """Whether some way of reading makes valid UTF-8 of it, which proper text almost never is by chance."""
    return any(undo(token, "utf-8", r) is not None for r in READ_AS)


def fit(texts: list[str], order: int = ORDER) -> Repairer:
    """Models of the clean part of the texts, and a margin validated on held-out ones.

    Two passes: tokens that read as UTF-8 under some wrong encoding are left out of the first model; texts that this
    model finds garbled are left out of the second as well. An empty list gives a model under which nothing is found.
    """
    texts = [t for t in texts if t and "�" not in t]
    bad: dict[str, bool] = {}

    def clean_counts(some: list[str]) -> Counter:
        counts = _token_counts(some)
        for token in counts:
            if not token.isascii() and token not in bad:
                bad[token] = _reads_as_utf8(token)
        return Counter({t: n for t, n in counts.items() if not bad.get(t)})

    held, kept = texts[::5], [t for k, t in enumerate(texts) if k % 5]
    first = Repairer(CharModels({"clean": clean_counts(kept)}, order))
    well = lambda some: [t for t, (gain, _) in zip(some, first.find(some)) if gain < LEAST_MARGIN]
    repairer = Repairer(CharModels({"clean": clean_counts(well(kept))}, order))
    repairer.margin = validate_margin(repairer, well(held))
    return repairer


def validate_margin(repairer: Repairer, clean: list[str], wrong: float = 0.001, missed: float = 0.01) -> float:
    """The least margin, from ``LEAST_MARGIN`` on, that at most the share ``wrong`` of clean held-out texts passes; but
    none that more than the share ``missed`` of their words falls under once they are garbled."""
    gains = Counter(gain for gain, _ in repairer.find(clean))
    return _margin(gains, Counter(_turned_gains(repairer, sorted({w for t in clean for w in _high_words(t)}))), wrong, missed)


def _high_words(text: str) -> list[str]:
    return [w for w in text.split() if not w.isascii() and w.isalpha()]


def _turned_gains(repairer: Repairer, words: list[str]) -> list[float]:
    """The gains of the words once garbled, each by a chain that its hash chooses, where they have any."""
    turned = [garble(w, CHAINS[crc32(w.encode()) % len(CHAINS)]) for w in words]
    return [float(gain) for (gain, _), w, t in zip(repairer.find(turned), words, turned) if t != w and gain > 0]


def _at(gains: Counter, place: int) -> float:
    """The gain of a place in the order of gains, from their numbers."""
    gain = 0.0
    for gain in sorted(gains):
        if (place := place - gains[gain]) < 0:
            break
    return float(gain)


def _margin(gains: Counter, recall: Counter, wrong: float = 0.001, missed: float = 0.01) -> float:
    """The margin from the gains of clean texts and of garbled words with their numbers, by ``validate_margin``'s rule."""
    rows, words = sum(gains.values()), sum(recall.values())
    if not rows or not words:
        return LEAST_MARGIN
    low = _at(gains, min(rows - 1, int(rows * (1 - wrong)))) + 0.5
    return max(LEAST_MARGIN, min(low, _at(recall, int(words * missed))))


def _tokens(texts: DataFrame) -> DataFrame:
    """``token, n0, n1``: how often the texts (``text, half``; half -1 counts for neither) have each token, by their half.

    Cut at blanks of ASCII only: blanks of other kinds are inside tokens as they are judged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, half = batch["text"], batch["half"]
            for k in (-1, 0, 1):
                found = pc.value_counts(pc.ascii_split_whitespace(text.filter(pc.equal(half, k))).flatten())
                token, n = found.field("values"), found.field("counts")
                if (rare := pc.match_substring_regex(token, "[\x1c-\x1f]")).true_count:  # blanks too
                    parts = [(p, c) for t, c in zip(token.filter(rare).to_pylist(), n.filter(rare).to_pylist()) for p in _RARE_BLANKS.split(t)]
                    token = pa.concat_arrays([token.filter(pc.invert(rare)), pa.array([p for p, _ in parts], token.type)])
                    n = pa.concat_arrays([n.filter(pc.invert(rare)), pa.array([c for _, c in parts], n.type)])
                none = pa.array(np.zeros(len(n), np.int64))
                yield pa.RecordBatch.from_arrays([token, n if k == 0 else none, n if k == 1 else none], ["token", "n0", "n1"])

    numbers = [F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1)]
    found = texts.select("text", "half").mapInArrow(run, "token string, n0 bigint, n1 bigint").where("token <> ''").groupBy("token").agg(*numbers)
    # Digits become noughts in the distinct tokens, which are far fewer characters than the texts.
    plain = F.translate("token", "123456789", "000000000").alias("token")
    return found.select(plain, "n0", "n1").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _with_judged(tokens: DataFrame, repairers: list[Repairer]) -> list[Repairer]:
    """The repairers with what they say of (some of) the tokens, each of which one task judges."""
    spark: SparkSession = tokens.sparkSession
    shared = spark.sparkContext.broadcast(repairers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = pdf["token"].tolist()
            undone = cache(_readings)  # the same for each of the repairers
            for k, tool in enumerate(shared.value):
                said = [hit or (0.0, -1) for hit in tool.judge(some, undone)]
                yield pd.DataFrame({"k": np.full(len(some), k, np.int32), "token": some, "gain": np.array([g for g, _ in said], float), "chain": np.array([c for _, c in said], np.int32)})

    some = tokens.select("token").limit(BEFOREHAND).repartition(spark.sparkContext.defaultParallelism)
    for batch in some.mapInPandas(run, "k int, token string, gain double, chain int").toArrow().to_batches():
        for k, token, gain, chain in zip(*(batch[c].to_pylist() for c in ("k", "token", "gain", "chain"))):
            repairers[k].judged[token] = None if chain < 0 else (gain, chain)
    shared.destroy(blocking=True)
    return repairers


def fit_on(chunks: DataFrame, *beyond: DataFrame, order: int = ORDER) -> Repairer:
    """``fit`` on all texts of a table, for texts of this table and the strings of those ``beyond``: all tokens are counted, the margin is validated on all rows.

    Each half of the rows is judged by the model of the other half, the repairer has the model of both. The driver gets
    the n-grams that tokens which can be judged ask for (``charsums``) and histograms of gains.
    """
    spark: SparkSession = chunks.sparkSession
    half = F.pmod(F.xxhash64("chunk_id", F.lit(5)), F.lit(2)).cast("int")
    texts = chunks.where(F.col("text").isNotNull() & (F.col("text") != "")).select("text", F.when(F.contains("text", F.lit("�")), -1).otherwise(half).alias("half"))
    every = texts  # those of other tables count for neither half
    for column in [df.select(F.col(c).alias("text")) for df in beyond for c, kind in df.dtypes if kind == "string"]:
        every = every.unionByName(column.where("text <> ''").select("text", F.lit(-1).alias("half")))
    tokens = cut_lineage(_tokens(every))
    asked = spark.sparkContext.broadcast(asked_of(tokens.where(F.col("token").rlike(r"[^\x00-\x7f]|\?")), order))
    proper = lambda token: not _reads_as_utf8(token)
    sums = cut_lineage(sums_of(tokens, order, asked, proper))
    doubtful = tokens.where(F.length("token") < F.octet_length("token"))
    first = spark.sparkContext.broadcast(_with_judged(doubtful, [Repairer(m) for m in models_of(sums, order)[:2]]))
    # Texts without a character outside ASCII have no gain: only the others need be looked at.
    high = F.length("text") < F.octet_length("text")
    judged = spread(texts.where((F.col("half") >= 0) & high))

    def garbled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The garbled texts, and of the others of a half, as one row, the distinct tokens, how many each text has and which."""
        for pdf in batches:
            for k, part in pdf.groupby("half"):  # each half under the model of the other
                tokens, sizes, places = _numbered(part["text"].tolist())
                clean = first.value[1 - k].gains_of(tokens, sizes, places) < LEAST_MARGIN
                yield part[~clean].assign(tokens=None, sizes=None, places=None)
                met, places = np.unique(places[np.repeat(clean, sizes)], return_inverse=True)
                row = "\n".join([tokens[i] for i in met.tolist()]), sizes[clean].astype(np.int32).tobytes(), places.astype(np.int32).tobytes()
                yield pd.DataFrame([(None, k, *row)], columns=["text", "half", "tokens", "sizes", "places"])

    split = cut_lineage(judged.mapInPandas(garbled, "text string, half int, tokens string, sizes binary, places binary"))
    removed = sums_of(_tokens(split.where("text is not null").select("text", "half")), order, asked, proper)
    *parts, repairer = _with_judged(doubtful, [Repairer(m) for m in models_of(less(sums, removed), order)])
    second = spark.sparkContext.broadcast(parts)

    def validated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[tuple[str, int]] = set()
        for half, tokens, sizes, places in joined.from_iterable(pdf.itertuples(index=False) for pdf in batches):
            tokens = tokens.split("\n") if tokens else []
            gains = second.value[1 - half].gains_of(tokens, np.frombuffer(sizes, np.int32), np.frombuffer(places, np.int32))
            gains = Counter(np.round(gains, 2).tolist())
            words = {(w, half) for t in tokens for w in _high_words(t)} - told
            told = words if len(told) > MEMO else told | words
            yield pd.DataFrame({
                "word": pd.Series([None] * len(gains) + [w for w, _ in words], dtype=object), "half": np.array([0] * len(gains) + [k for _, k in words], np.int32),
                "gain": np.array([*gains, *[0.0] * len(words)], float), "n": np.array([*gains.values(), *[0] * len(words)], np.int64),
            })

    found = cut_lineage(split.where("text is null").select("half", "tokens", "sizes", "places").mapInPandas(validated, "word string, half int, gain double, n bigint").groupBy("word", "half", "gain").agg(F.sum("n").alias("n")))

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in (0, 1):
                yield pd.DataFrame({"gain": np.round(_turned_gains(second.value[1 - k], pdf["word"][pdf["half"] == k].tolist()), 2)})

    words = found.where("word is not null").select("word", "half").repartition(spark.sparkContext.defaultParallelism)
    recall = Counter({r.gain: r.n for r in words.mapInPandas(turned, "gain double").groupBy("gain").agg(F.count("*").alias("n")).collect()})
    gains = Counter({r.gain: r.n for r in found.where("word is null").select("gain", "n").collect()})
    gains[0.0] += texts.where((F.col("half") >= 0) & ~high).count()
    for shared in (asked, first, second):  # what was found is written, so nobody needs them again
        shared.destroy(blocking=True)
    repairer.margin = _margin(gains, recall)
    return repairer


def restore_encoding(chunks: DataFrame, repairer: Repairer | None = None, keep_text: bool = True) -> DataFrame:
    """``chunk_id, gain, chain, recoverable, restored``: the affected chunks, each once.

    ``chain`` names the written and the assumed encoding of the most tokens (null where only replacement marks show it);
    ``recoverable`` is false where replacement marks took characters, ``restored`` then has all else restored, and null
    without ``keep_text``. Null, empty and plain ASCII texts without replacement marks are never affected. A chunk_id that
    is repeated comes once, under the largest gain. Map-side but for that: only affected rows are shuffled.
    """
    spark: SparkSession = chunks.sparkSession
    shared = spark.sparkContext.broadcast(repairer or fit_on(chunks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixer: Repairer = shared.value
        for pdf in batches:
            out = []
            ids, texts = pdf["chunk_id"].tolist(), pdf["text"].tolist()
            for chunk, text, (gain, hits) in zip(ids, texts, fixer.find(texts)):
                lost = fixer.lost(text)
                if not lost and gain < fixer.margin:
                    continue
                restored, used = fixer.repair(text, hits) if keep_text and hits else (text if keep_text else None, [h[1] for h in hits.values()])
                chain = " + ".join(f"{w} as {r}" for w, r in CHAINS[used[0]]) if used else None
                out.append((chunk, gain, chain, not lost, restored))
            yield pd.DataFrame(out, columns=["chunk_id", "gain", "chain", "recoverable", "restored"])

    # Inside the JVM: a text can be affected only with a character outside ASCII or a question mark in it.
    doubtful = chunks.select("chunk_id", "text").where(F.col("text").rlike(r"[^\x00-\x7f]|\?"))
    found = spread(doubtful).mapInPandas(run, "chunk_id bigint, gain double, chain string, recoverable boolean, restored string")
    best = F.max_by(F.struct("gain", "chain", "recoverable", "restored"), F.struct("gain", "restored"))
    return found.groupBy("chunk_id").agg(best.alias("b")).select("chunk_id", "b.*")
