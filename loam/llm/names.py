"""Problem 6: rows that name the same person or vendor, however the name is typed.

A name is read into a core (surname, or the vendor's own word) and a qualifier (given name under its usual form, or the
trade). Distinct readings, not rows, are blocked by the qualifier and the phonetic code of the core, with each code that
leaves one sound out, so that one wrong sound still meets; all members of a block are compared by Jaro-Winkler and edit
distance, but those its most frequent reading joins already. Accepted pairs, and the readings that one row gives of itself, form connected
components. Readings without a full qualifier (initials, no trade) join a component only where just one fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.operators.components import connected_components
from loam.session import cut_lineage

#: Least Jaro-Winkler similarity of two cores one slip apart and of others.
SLIP, SIMILAR = 0.8, 0.88
#: Rows of an entity that one part of its pairs has.
ENTITY_ROWS = 2_000

#: Given names and the short forms that stand for them.
NICKNAMES = {
    "alexander": "alex sasha sandy xander sascha alec aleksandr alexandre", "oleksandr": "oles olek", "alexandra": "lexi", "anastasia": "nastya stacy anya nastia", "anna": "ann annie anne", "andrew": "andy drew", "andreas": "andi",
    "anthony": "tony", "antonio": "toni tonino", "barbara": "babs barb", "benedikt": "ben bene benni beni", "benjamin": "benny benji", "bernhard": "bernd bernie", "boris": "borya", "catherine": "cathy cate",
    "charles": "charlie chuck chas carl", "christopher": "chris kit topher", "christina": "tina chrissy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dmitri": "dima mitya dimka",
    "dorothy": "dot dottie", "edward": "ed eddie ned", "elizabeth": "liz beth betty lizzie eliza lisa elsie", "ekaterina": "katya", "eleanor": "ellie nora", "emily": "emmy", "francesca": "franca cesca", "francisca": "paquita paca pacha curra",
    "francisco": "paco pancho curro", "frederick": "fred freddy", "friedrich": "fritz friedl fiete", "george": "georgie", "georg": "schorsch", "giovanni": "gianni nino vanni", "giuseppe": "beppe peppe pino peppino beppino",
    "gregory": "greg", "hans": "hansi", "heinrich": "heinz heiner hein heini", "henry": "hank harry", "ignacio": "nacho ignasi", "irina": "ira", "isabel": "isa bella", "ivan": "vanya", "jacob": "jake", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "johannes": "hannes jo joha johann", "john": "jack johnny", "jonathan": "jon", "jose": "pepe", "joseph": "joe joey", "josef": "sepp", "joshua": "josh", "judith": "judy", "katharina": "kathi kati kathe katha katrin",
    "kenneth": "ken kenny", "lawrence": "larry lorry laurie", "ludwig": "lutz", "luigi": "gigi", "margaret": "maggie peggy meg marge greta", "margarethe": "gretel", "maria": "masha marie mia", "matthew": "matt", "matthias": "matze", "maximilian": "max",
    "michael": "mike mick mickey", "mikhail": "misha mishka", "natalia": "natasha", "nicholas": "nick nicky", "nikolai": "kolya nikolasha kolka", "olga": "olya", "patricia": "patty trish pat tricia patsy", "patrick": "paddy", "pavel": "pasha",
    "peter": "pete", "rebecca": "becky", "richard": "rick dick rich", "robert": "bob rob bobby robbie bert", "ronald": "ron", "rosalind": "roz ros rosa lindy", "samuel": "sam", "sergei": "seryozha", "stephen": "steve", "susanna": "sue susi susie suzy sanna",
    "svetlana": "sveta", "tatiana": "tanya", "theodore": "ted teddy theo", "theresa": "tess terry", "thomas": "tom tommy", "ulrike": "uli rike ulli", "victoria": "vicky tori", "vincenzo": "enzo", "vladimir": "vova volodya vlad", "wilhelm": "willi",
    "william": "bill will billy willy liam", "yevgenia": "zhenya evgenia genia yevgeniya", "yuri": "yura", "zachary": "zack zach zac zak",
}
#: Words about a person, a vendor's legal form, and the trades with their usual short forms.
TITLES = set("dr prof ing dipl mr mrs ms miss frau herr hr sr sra jr phd msc bsc eng mag sig sigra mme mlle dott don".split())
LEGAL = set("ag oy ooo llc ltd inc gmbh sa bv spa co corp plc kg ohg ug se nv as ab sas sarl srl sl oao zao ao pao limited incorporated corporation company the".split())
TRADES = {
    "automation": "autom", "chemicals": "chem", "components": "comp cmpnts", "consulting": "cons", "control": "ctrl cntrl", "controls": "ctrls", "drives": "drv", "dynamics": "dyn", "electric": "elec el", "electronics": "electr", "energy": "enrgy", "engineering": "eng engrg engg",
    "equipment": "equip eqpt", "filtration": "filtr filt", "hydraulics": "hydr", "industries": "ind inds", "instruments": "instr instrs", "international": "intl int", "laboratories": "labs lab", "logistics": "logist log", "machinery": "mach", "maintenance": "maint",
    "materials": "mat", "measurement": "meas", "metering": "metrg met", "pneumatics": "pneum", "power": "pwr", "process": "proc prcs", "pumps": "pmps pmp", "robotics": "rob", "safety": "saf", "sensors": "sens snsrs", "services": "svcs svc serv",
    "software": "sw softw", "solutions": "sol solns", "supplies": "suppl", "systems": "sys syst", "technologies": "tech technol", "technology": "techn", "thermal": "therm thrml", "tools": "tls", "trading": "trdg", "valve": "vlv", "valves": "vlvs", "works": "wks wrks",
}
#: Russian letters in Latin, and Latin letters that no accent rule takes apart.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f h ts ch sh shch  y  e yu ya".split(" ")))
FOLD = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})

_GIVEN = {short: name for name, shorts in NICKNAMES.items() for short in (name, *shorts.split())}
_TRADE = {short: name for name, shorts in TRADES.items() for short in (name, *shorts.split())}
_SOUNDS = [(re.compile(a), b) for a, b in (
    ("sch|tch|ch|sh|kh|ck", "k"), ("ph", "f"), ("th", "t"), ("tz|ts|z+|s+", "s"), ("x", "ks"), ("[cgkq]+", "k"), ("[bp]+", "p"), ("[fvw]+", "f"), ("[dt]+", "t"), (r"(.)\1+", r"\1"), ("[aeiouyjh]+", ""),
)]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    turned = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours."""
    two, one = [], list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            k = min(one[j] + 1, now[-1] + 1, one[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                k = min(k, two[j - 2] + 1)
            now.append(k)
        two, one = one, now
    return one[-1]


@lru_cache(100_000)
def sounds(word: str) -> str:
    """The phonetic code of a word: its consonants by class, doubled letters once."""
    for pattern, to in _SOUNDS:
        word = pattern.sub(to, word)
    return word


def nearby(code: str) -> list[str]:
    """The code and, if it is long enough, each that lacks one sound."""
    return sorted({code} | ({code[:k] + code[k + 1 :] for k in range(len(code))} if len(code) > 2 else set()))


def same_core(a: str, b: str) -> bool:
    if a == b:
        return True
    likeness = jaro_winkler(a, b)
    if likeness < SLIP:
        return False
    distance = edits(a, b)
    return distance <= 1 or (distance <= 2 and likeness >= SIMILAR and (sounds(a) == sounds(b) or min(len(a), len(b)) >= 10))


@lru_cache(200_000)
def folded(text: str) -> str:
    """Latin letters without accents; Russian letters by sound; case is kept."""
    out = []
    for c in unicodedata.normalize("NFKC", text):
        low = c.lower()
        if low in CYRILLIC:
            to = CYRILLIC[low]
            out.append(to.capitalize() if c != low else to)
        else:
            out.append(c)
    plain = unicodedata.normalize("NFKD", "".join(out))
    return "".join(c for c in plain if not unicodedata.combining(c)).translate(FOLD)


def _like(letter: str) -> set[str]:
    return {"j": {"j", "y", "i"}, "y": {"y", "j", "i"}, "v": {"v", "w"}, "w": {"w", "v"}, "k": {"k", "c"}, "c": {"c", "k"}, "z": {"z", "s"}}.get(letter, {letter})


def _closest_set(word: str) -> set[str]:
    return _like(word[0]) | {word[1]}


@lru_cache(200_000)
def given_name(word: str) -> str | None:
    return _lookup(word, "given")


@lru_cache(200_000)
def trade_word(word: str) -> str | None:
    if (known := _lookup(word, "trade")) is not None:
        return known
    longer = [t for t in TRADES if len(word) >= 4 and t.startswith(word)]
    return longer[0] if len(longer) == 1 else None


def _spelled(word: str) -> str:
    """One spelling for letters that transcriptions exchange."""
    for a, b in (("ph", "f"), ("th", "t"), ("w", "v"), ("c", "k"), ("q", "k"), ("y", "i"), ("j", "i"), ("x", "ks")):
        word = word.replace(a, b)
    return word


_BY_SPELLING = {which: {s: {v for k, v in table.items() if len(k) >= 5 and _spelled(k) == s} for s in {_spelled(k) for k in table if len(k) >= 5}} for which, table in (("given", _GIVEN), ("trade", _TRADE))}


def _lookup(word: str, which: str) -> str | None:
    """The table's value for a word: itself, as transcriptions spell it, or but for one slip of the hand; None if several fit."""
    table = _GIVEN if which == "given" else _TRADE
    if word in table:
        return table[word]
    if len(word) < 5:
        return None
    spelled = _spelled(word)
    found = _BY_SPELLING[which].get(spelled)
    if not found:
        heads = _closest_set(word)
        found = {table[k] for k in table if len(k) >= 5 and abs(len(k) - len(word)) <= 1 and k[0] in heads and edits(k, word) <= 1}
    if not found:
        found = {v for s, vs in _BY_SPELLING[which].items() if abs(len(s) - len(spelled)) <= 1 and s[:1] == spelled[:1] and edits(s, spelled) <= 1 for v in vs}
    return next(iter(found)) if len(found) == 1 else None


_NOTE = re.compile(r"\([^)]*\)|\[[^\]]*\]|@\S*")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def read_person(name: str) -> tuple[int, str, str, str] | None:
    """``level, qualifier, core, extra`` of a person's name; level 2 with a given name, 1 with an initial; None if it is
    no such name. Extra are all words where none is a known given name, or all are, so that either may be the surname."""
    text = _NOTE.sub(" ", folded(name)).strip()
    if "," in text:
        last, _, rest = text.partition(",")
        text = f"{rest} {last}"
    if not re.search(r"\s", text):
        text = _HUMP.sub(" ", text)
    tokens = [t for t in re.findall(r"[a-z']+", text.lower().replace(".", " ").replace("_", " ").replace("-", " ")) if t not in TITLES]
    words, initials = [t for t in tokens if len(t) > 1], [t for t in tokens if len(t) == 1]
    if not words:
        return None
    if len(words) == 1:
        if initials:
            return 1, initials[0], words[0], ""
        glued = words[0]
        for k in range(3, len(glued) - 3):
            if glued[:k] in _GIVEN and len(glued[:k]) >= 4:
                return 2, _GIVEN[glued[:k]], glued[k:], ""
        return (1, glued[0], glued[1:], "glued") if len(glued) > 4 else None
    known = [(k, g) for k, w in enumerate(words) if (g := _GIVEN.get(w))] or [(k, g) for k, w in enumerate(words) if (g := given_name(w))]
    at, given = known[0] if known else (0, f"~{words[0][0]}{sounds(words[0])}")
    rest = [w for k, w in enumerate(words) if k != at]
    rest = [w for w in rest if w not in _GIVEN] or rest[-1:]  # a middle name is no part of the surname
    return 2, given, "".join(rest), " ".join(words) if len(known) in (0, len(words)) else ""


def name_blocks(words: list[str]) -> list[str]:
    """Blocks of a name without a known given name: the sorted phonetic codes of all its words, and those with one sound
    less in one of them."""
    codes = [sounds(w) for w in words]
    return sorted({" ".join(sorted([*codes[:k], other, *codes[k + 1 :]])) for k in range(len(codes)) for other in nearby(codes[k])})


def same_words(a: str, b: str) -> bool:
    """Whether two names have the same words in some order; at most one differs, by a slip in a word of five letters or more."""
    x, y = sorted(a.split()), sorted(b.split())
    left, right = list((Counter(x) - Counter(y)).elements()), list((Counter(y) - Counter(x)).elements())
    return not left and not right or (len(left) == len(right) == 1 and min(len(left[0]), len(right[0])) >= 5 and same_core(left[0], right[0]))


def read_vendor(name: str) -> tuple[int, str, str, str] | None:
    """The same of a vendor's name: level 2 with a trade, 1 without, where the legal form qualifies; that is the extra too."""
    text = re.sub(r"[«»\"“”„'’]", " ", _NOTE.sub(" ", folded(name))).strip()
    if re.fullmatch(r"[A-Z]{2,5}", text):
        return None
    text = re.sub(r"\b((?:[A-Za-z]\.){1,3}[A-Za-z])\b\.?", lambda m: m.group().replace(".", ""), text)
    if not re.search(r"\s", text):
        text = _HUMP.sub(" ", text)
    tokens = re.findall(r"[a-z0-9]+", text.lower())
    legal = " ".join(sorted({t for t in tokens if t in LEGAL} - {"the", "co"}))
    words = [t for t in tokens if t not in LEGAL]
    if not words:
        return None
    if len(words) == 1:
        return (1, legal, words[0], legal) if len(words[0]) > 3 else None
    trades = [trade_word(w) for w in words]
    own = [w for w, t in zip(words, trades) if t is None] or words[:1]
    trade = sorted({t for w, t in zip(words, trades) if t is not None and w not in own})
    return (2, " ".join(trade), "".join(own), legal) if trade else (2, "~" + sounds("".join(own[1:])), own[0], legal) if len(own) > 1 else (1, legal, "".join(own), legal)


def _initials(name: str) -> str:
    return "".join(w[0] for w in re.findall(r"[a-z0-9]+", _HUMP.sub(" ", folded(name)).lower()) if w not in LEGAL)


def readings(kind: str, label: str | None, aliases: list[str] | None) -> list[tuple[int, str, str, str]]:
    """What a row calls itself: the readings of its label and of the aliases that agree with it; those of full level if
    there are any. A general word among the aliases agrees with no label."""
    read = read_person if kind == "person" else read_vendor
    own = read(label) if label and label.strip() else None
    out = {own} if own else set()
    glued = re.sub(r"[^a-z]", "", folded(label or "").lower())
    codes = set(nearby(sounds(own[2]))) if own else set()
    for alias in aliases or []:
        other = read(alias) if alias and alias.strip() else None
        if other is None:
            continue
        agrees = bool(codes & set(nearby(sounds(other[2])))) and (same_core(own[2], other[2]) or sounds(own[2]) == sounds(other[2])) if own else False
        if agrees or (len(other[2]) > 4 and other[2] in glued) or (own is None and kind == "vendor" and glued and glued == _initials(alias)):
            out.add(other)
    full = {r for r in out if r[0] == 2}
    return sorted(full or out)


def _read_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for upsert, kind, label, aliases in pdf[["upsert_id", "kind", "label", "aliases"]].itertuples(index=False):
            for level, qualifier, core, extra in readings(kind, label, None if aliases is None else list(aliases)):
                out.append((upsert, kind, level, qualifier, core, extra, nearby(sounds(core))))
        yield pd.DataFrame(out, columns=["upsert_id", "kind", "level", "qualifier", "core", "extra", "codes"])


@F.pandas_udf(T.BooleanType())
def same_core_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_core(x, y) for x, y in zip(a, b)], dtype=bool)


def _links(forms: DataFrame) -> DataFrame:
    """``src, dst``: verified links of all forms that share a block.

    Each is compared with its block's most frequent form; of two that both match it no more is asked, all other pairs of
    the block are compared as well.
    """
    keys = ["kind", "level", "qualifier", "code"]
    blocked = forms.select("form", "core", "n", F.explode("codes").alias("code"), "kind", "level", "qualifier")
    lead = blocked.groupBy(*keys).agg(F.max(F.struct("n", "core", "form")).alias("b")).select(*keys, F.col("b.core").alias("lead_core"), F.col("b.form").alias("lead"))
    judged = cut_lineage(blocked.join(lead, keys).where("form <> lead").withColumn("same", same_core_udf("core", "lead_core")))
    first = judged.where("same").select(F.col("form").alias("src"), F.col("lead").alias("dst"))
    others = judged.where("not same").select(*keys, F.col("form").alias("other"), F.col("core").alias("other_core"))
    pairs = judged.join(others, keys).where("form <> other and not (not same and form > other)").select("form", "core", "other", "other_core").distinct()
    rest = pairs.where(same_core_udf("core", "other_core")).select(F.col("form").alias("src"), F.col("other").alias("dst"))
    return first.unionByName(rest).distinct()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_blocks_udf(names: pd.Series) -> pd.Series:
    return pd.Series([name_blocks(n.split()) for n in names], dtype=object)


@F.pandas_udf(T.BooleanType())
def _same_words_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_words(x, y) for x, y in zip(a, b)], dtype=bool)


def _word_links(rows: DataFrame) -> DataFrame:
    """``src, dst``: forms of persons whose words do not say which is the surname and agree in any order."""
    names = rows.where("kind = 'person' and level = 2 and extra <> ''").groupBy("extra").agg(F.min("form").alias("form"))
    blocked = names.withColumn("block", F.explode(_name_blocks_udf("extra")))
    other = blocked.select("block", F.col("extra").alias("other"), F.col("form").alias("dst"))
    pairs = blocked.join(other, "block").where("extra < other and form <> dst").select("extra", "other", F.col("form").alias("src"), "dst").distinct()
    return pairs.where(_same_words_udf("extra", "other")).select("src", "dst")


def entity_of(upserts: DataFrame) -> DataFrame:
    """``upsert_id, kind, entity``: persons and vendors with the number of what they name; equal numbers mean the same.

    Type names count in any case and with blanks around. Rows without a name that can be read (null, blank, a bare
    abbreviation) and other types are left out. A row sent twice counts once; if its content differs, all its names count.
    """
    kind = F.lower(F.trim(F.regexp_replace("node_type", r"\s+", " ")))
    base = upserts.select("upsert_id", kind.alias("kind"), "label", "aliases").where(F.col("kind").isin("person", "vendor") & F.col("upsert_id").isNotNull())
    schema = "upsert_id bigint, kind string, level int, qualifier string, core string, extra string, codes array<string>"
    read = base.dropDuplicates(["upsert_id", "kind", "label", "aliases"]).mapInPandas(_read_rows, schema)
    rows = cut_lineage(read.withColumn("form", F.xxhash64("kind", "level", "qualifier", "core")))
    forms = rows.groupBy("form", "kind", "level", "qualifier", "core").agg(F.first("codes").alias("codes"), F.count("*").alias("n"))
    forms = cut_lineage(forms)
    own = rows.groupBy("upsert_id", "kind").agg(F.min("form").alias("dst"))
    within = rows.select("upsert_id", "kind", F.col("form").alias("src")).join(own, ["upsert_id", "kind"]).where("src <> dst").select("src", "dst").distinct()
    linked = connected_components(_links(forms).unionByName(_word_links(rows)).unionByName(within))
    group = cut_lineage(forms.join(linked.select(F.col("node").alias("form"), "component"), "form", "left").withColumn("component", F.coalesce("component", "form")))

    # Initials and vendors without a trade: the one component of full readings that fits, or that fits by its legal form.
    best = F.max_by(F.struct("core", "codes"), F.struct("n", "core"))
    full = group.where("level = 2")
    head = F.when(F.col("kind") == "person", F.substring(F.ltrim("qualifier", F.lit("~")), 1, 1)).otherwise(F.lit(""))
    reps = full.groupBy("kind", "component", head.alias("head")).agg(best.alias("b"))
    legal = rows.where("level = 2 and kind = 'vendor' and extra <> ''").join(group.select("form", "component"), "form").groupBy("component").agg(F.max_by("extra", F.length("extra")).alias("full_legal"))
    reps = reps.join(legal, "component", "left").select("kind", F.col("component").alias("target"), "head", F.col("b.core").alias("full_core"), F.explode("b.codes").alias("code"), "full_legal")
    mixed = full.select("component").distinct()
    weak = group.where("level = 1").join(mixed, "component", "left_anti")
    weak_legal = rows.where("level = 1").groupBy("form").agg(F.max("extra").alias("legal"))
    tried = weak.join(weak_legal, "form").select("kind", "component", "core", "legal", head.alias("head"), F.explode("codes").alias("code"))
    fits = tried.join(reps, ["kind", "head", "code"]).where(same_core_udf("core", "full_core"))
    by_legal = (F.col("legal") != "") & (F.col("legal") == F.col("full_legal"))
    counted = fits.groupBy("component").agg(
        F.min("target").alias("least"), F.max("target").alias("most"), F.min(F.when(by_legal, F.col("target"))).alias("l_least"), F.max(F.when(by_legal, F.col("target"))).alias("l_most")
    )
    target = F.when(F.col("least") == F.col("most"), F.col("least")).when(F.col("l_least") == F.col("l_most"), F.col("l_least"))
    moved = counted.select("component", target.alias("target")).where(F.col("target").isNotNull())
    final = group.select("form", "component").join(moved, "component", "left").select("form", F.coalesce("target", "component").alias("entity"))
    return own.withColumnRenamed("dst", "form").join(final, "form").select("upsert_id", "kind", "entity")


def same_entity_pairs(upserts: DataFrame) -> DataFrame:
    """``upsert_id_a, upsert_id_b``: each pair of different rows of one entity, the smaller first.

    The rows of an entity of more than ``ENTITY_ROWS`` are dealt to so many parts that its pairs are spread over tasks.
    """
    found = cut_lineage(entity_of(upserts))
    keys = ["kind", "entity"]
    large = found.groupBy(*keys).agg(F.ceil(F.count("*") / ENTITY_ROWS).cast("int").alias("parts"))
    dealt = found.join(large, keys)
    part = F.pmod(F.xxhash64("upsert_id"), F.col("parts")).cast("int")
    a = dealt.select(F.col("upsert_id").alias("upsert_id_a"), *keys, part.alias("part"))
    b = dealt.select(F.col("upsert_id").alias("upsert_id_b"), *keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, [*keys, "part"]).where("upsert_id_a < upsert_id_b").select("upsert_id_a", "upsert_id_b")
