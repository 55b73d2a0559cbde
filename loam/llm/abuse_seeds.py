"""Words that the content classifier of problem 9 starts from, how they are put together, and how people disguise them.

A small general lexicon: words of insult, contempt, violence and sex, and technical senses of look-alike words, each used in
frames of a few words. Reviewed documents teach the classifier all longer wording.
"""

from __future__ import annotations

import numpy as np

#: The lexicon. N insults, A words put before them, P expletives addressed to somebody, G groups that are
#: targets, H what contempt calls them, K what is done to a victim, B what is hurt, X sexual words, S sexual acts.
LEXICON = {
    "en": {
        "N": "idiot|moron|imbecile|cretin|fool|loser|bastard|scumbag|jerk|pig|bitch|asshole|dumbass|dickhead|prick|retard|wanker|twat|slut|whore|cunt|scum|piece of shit|coward|liar",
        "A": "stupid|pathetic|worthless|useless|brainless|miserable|filthy|ugly|fucking|disgusting|bloody|damn|lazy|dirty", "P": "fuck you|fuck off|screw you|shut up|piss off|go to hell|get lost|drop dead|die|kill yourself",
        "G": "women|girls|gays|lesbians|immigrants|migrants|refugees|foreigners|blacks|jews|muslims|gypsies|disabled people|asians|arabs", "H": "vermin|scum|animals|parasites|trash|disease|rats|subhuman|stupid|inferior|thieves|criminals|disgusting|filth",
        "K": "kill|beat|hurt|stab|shoot|strangle|murder|punch|find|burn|destroy", "B": "face|jaw|teeth|arm|neck|legs|skull|nose|bones|head", "X": "tits|ass|pussy|cock|dick|boobs|naked|nude|nudes|horny|porn|orgasm|blowjob|sexy", "S": "fuck|lick|suck|screw|undress|touch",
    },
    "de": {
        "N": "Idiot|Vollidiot|Depp|Trottel|Schwachkopf|Versager|Arschloch|Mistkerl|Drecksau|Schwein|Penner|Wichser|Schlampe|Fotze|Hurensohn|Dummkopf|Nutte|Missgeburt|Spast|Abschaum", "A": "blöder|dummer|dreckiger|erbärmlicher|verdammter|verfickter|hirnloser|widerlicher|elender|blöde|dumme|fauler",
        "P": "fick dich|verpiss dich|halt die Fresse|halt das Maul|leck mich|geh sterben|bring dich um|scher dich zum Teufel|hau ab|verrecke", "G": "Frauen|Weiber|Schwule|Lesben|Ausländer|Flüchtlinge|Migranten|Juden|Muslime|Zigeuner|Behinderte|Schwarze",
        "H": "Ungeziefer|Abschaum|Tiere|Parasiten|Dreck|Ratten|Untermenschen|dumm|minderwertig|Diebe|Verbrecher|eklig", "K": "töte|schlage|verprügle|ersteche|erschieße|erwürge|ermorde|finde|vernichte", "B": "Zähne|Knochen|Nase|Arme|Fresse|Beine|Kopf|Hals", "X": "Titten|Arsch|Möse|Schwanz|Brüste|nackt|geil|Porno|Nacktfotos|Orgasmus|sexy", "S": "ficken|lecken|blasen|vögeln|ausziehen|begrapschen",
    },
    "fr": {
        "N": "crétin|con|connard|abruti|imbécile|idiot|salaud|ordure|débile|enculé|pourriture|salope|connasse|pute|bâtard|raclure|minable|taré|merde|lâche", "A": "sale|gros|pauvre|petit|espèce de|misérable|putain de|stupide|foutu",
        "P": "va te faire foutre|ferme ta gueule|ta gueule|dégage|casse-toi|va au diable|crève|va crever|tue-toi|va te faire enculer", "G": "femmes|pédés|immigrés|étrangers|migrants|réfugiés|juifs|musulmans|noirs|arabes|gitans|handicapés|lesbiennes",
        "H": "vermine|parasites|animaux|déchets|rats|racaille|stupides|inférieurs|voleurs|criminels|dégoûtants", "K": "tuer|frapper|cogner|poignarder|étrangler|massacrer|égorger|retrouver|brûler", "B": "gueule|dents|bras|jambes|mâchoire|nez|tête|cou", "X": "seins|cul|chatte|bite|nichons|nue|nues|porno|orgasme|sexy|excitée", "S": "baiser|lécher|sucer|niquer|déshabiller|peloter",
    },
    "es": {
        "N": "idiota|imbécil|cabrón|gilipollas|estúpido|inútil|hijo de puta|cerdo|puta|zorra|basura|subnormal|cretino|pendejo|maricón|bastardo|tarado|cobarde|perra|escoria", "A": "maldito|puto|pedazo de|asqueroso|pobre|miserable|jodido|sucio|estúpido",
        "P": "vete a la mierda|que te jodan|cállate|lárgate|muérete|vete al infierno|mátate|jódete|cierra la boca|que te den", "G": "mujeres|maricones|inmigrantes|extranjeros|refugiados|judíos|musulmanes|negros|moros|gitanos|gays|discapacitados",
        "H": "escoria|parásitos|animales|basura|ratas|una plaga|estúpidos|inferiores|ladrones|criminales|asquerosos", "K": "matar|golpear|pegar|apuñalar|disparar|estrangular|asesinar|encontrar|quemar", "B": "cara|dientes|brazos|piernas|mandíbula|cabeza|cuello|huesos", "X": "tetas|culo|coño|polla|pechos|desnuda|desnudas|porno|orgasmo|cachonda|sexy", "S": "follar|lamer|chupar|coger|desnudar|manosear",
    },
    "it": {
        "N": "idiota|cretino|stronzo|imbecille|deficiente|coglione|bastardo|pezzo di merda|fallito|porco|puttana|troia|scemo|figlio di puttana|testa di cazzo|feccia|verme|codardo|zoccola", "A": "brutto|povero|sporco|maledetto|schifoso|lurido|fottuto|inutile|stupido",
        "P": "vaffanculo|stai zitto|vai a farti fottere|fottiti|vai al diavolo|crepa|muori|ammazzati|levati dai piedi|chiudi la bocca", "G": "donne|froci|immigrati|stranieri|migranti|profughi|ebrei|musulmani|neri|zingari|negri|disabili|lesbiche",
        "H": "feccia|parassiti|animali|spazzatura|ratti|una piaga|stupidi|inferiori|ladri|criminali|schifosi", "K": "uccidere|picchiare|colpire|accoltellare|sparare|strangolare|ammazzare|trovare|bruciare", "B": "faccia|denti|braccia|gambe|mascella|testa|collo|ossa", "X": "tette|culo|figa|cazzo|seno|nuda|nude|porno|orgasmo|eccitata|sexy", "S": "scopare|leccare|succhiare|chiavare|spogliare|palpare",
    },
    "ru": {
        "N": "идиот|дебил|придурок|кретин|урод|тварь|мразь|сволочь|козёл|скотина|ублюдок|дурак|сука|шлюха|тупица|мудак|гад|подонок|гнида|трус", "A": "жалкий|тупой|грязный|конченый|мерзкий|безмозглый|вонючий|проклятый|никчёмный|ленивый",
        "P": "пошёл на хуй|иди на хуй|заткнись|иди к чёрту|убирайся|сдохни|убей себя|пошёл вон|закрой рот|отвали", "G": "бабы|женщины|мигранты|приезжие|геи|педики|евреи|чурки|цыгане|иностранцы|беженцы|инвалиды|негры|мусульмане",
        "H": "отбросы|паразиты|животные|мусор|крысы|зараза|тупые|недочеловеки|воры|преступники|грязь", "K": "убью|побью|изобью|зарежу|застрелю|задушу|прикончу|найду|сожгу|уничтожу", "B": "шею|зубы|руки|ноги|челюсть|голову|морду|кости", "X": "сиськи|жопа|член|голая|голые|порно|секс|оргазм|возбуждённая|пизда|хуй", "S": "трахать|лизать|сосать|ебать|раздеть|лапать",
    },
}
#: Frames in which abuse is said, of four words at most beside the lexicon's.
ABUSIVE = {
    "en": ["you {A} {N}", "you are a {N}", "you're a {A} {N}", "what a {A} {N}", "{P}", "{P} you {N}", "{N}", "this {A} {N}", "{G} are {H}", "all {G} are {H}", "i hate {G}", "no {G} here", "{G} are too {H}", "i will {K} you", "we will {K} you", "break your {B}", "hit your {B}", "i hope you die", "your {X}", "her {X}", "naked {X}", "i want to {S} you", "{S} my {X}", "{S} her {X}", "{X} {X}"],
    "de": ["du {A} {N}", "du bist ein {N}", "so ein {A} {N}", "was für ein {N}", "{P}", "{P} du {N}", "{N}", "{G} sind {H}", "alle {G} sind {H}", "ich hasse {G}", "{G} raus", "{G} sind zu {H}", "ich {K} dich", "wir {K} dich", "dir die {B} brechen", "auf die {B}", "hoffentlich stirbst du", "deine {X}", "ihre {X}", "nackte {X}", "ich will dich {S}", "{X} {S}", "{X} {X}"],
    "fr": ["tu es un {N}", "{A} {N}", "quel {A} {N}", "espèce de {N}", "{P}", "{P} {N}", "{N}", "les {G} sont {H}", "tous les {G} sont {H}", "je déteste les {G}", "dehors les {G}", "je vais te {K}", "on va te {K}", "casser la {B}", "casser tes {B}", "j'espère que tu crèves", "ton {X}", "ses {X}", "toute {X}", "je veux te {S}", "{S} son {X}", "{X} {X}"],
    "es": ["eres un {N}", "{A} {N}", "qué {A} {N}", "{P}", "{P} {N}", "{N}", "los {G} son {H}", "todos los {G} son {H}", "odio a los {G}", "fuera los {G}", "te voy a {K}", "vamos a {K}", "te rompo la {B}", "romperte los {B}", "ojalá te mueras", "tu {X}", "sus {X}", "toda {X}", "quiero {S} contigo", "{S} su {X}", "{X} {X}"],
    "it": ["sei un {N}", "{A} {N}", "che {A} {N}", "{P}", "{P} {N}", "{N}", "gli {G} sono {H}", "tutti gli {G} sono {H}", "odio gli {G}", "fuori gli {G}", "ti voglio {K}", "noi ti vogliamo {K}", "ti rompo la {B}", "spaccarti i {B}", "spero che muori", "il tuo {X}", "le sue {X}", "tutta {X}", "voglio {S} te", "{S} il suo {X}", "{X} {X}"],
    "ru": ["ты {A} {N}", "ты {N}", "какой {A} {N}", "{P}", "{P} {N}", "{N}", "{G} это {H}", "все {G} {H}", "ненавижу {G}", "{G} вон отсюда", "я тебя {K}", "мы тебя {K}", "сломаю тебе {B}", "разобью твою {B}", "чтоб ты сдох", "твоя {X}", "её {X}", "вся {X}", "хочу тебя {S}", "{S} {X}", "{X} {X}"],
}
#: Technical senses of words that look alike (V with O, or T alone), and rules (R is forbidden: F).
TECHNICAL = {
    "en": {"V": "kill|abort|terminate|execute|strip|blow|bang|screw|grease|strike|penetrate|lick|touch", "O": "the process|the job|the thread|the task|the wire|the fuse|the bolt|the nipple|the seal|the script|the cock valve|the surface", "T": "master and slave|male connector|female connector|grease nipple|butt weld|stopcock|ball cock|penetration depth|dead end|hard stop|naked eye|bare conductor|crack detection|",
           "R": "insults|threats|hate speech|abusive language|harassment|sexual remarks", "F": "are forbidden|will be deleted|must be reported|are not tolerated"},
    "de": {"V": "töten|abbrechen|beenden|ausführen|abisolieren|schmieren|festziehen|einschlagen|berühren", "O": "den Prozess|den Auftrag|das Kabel|die Mutter|die Schraube|den Nippel|die Dichtung|das Skript", "T": "Schmiernippel|Mutter und Schraube|Stecker männlich|Buchse weiblich|blanker Leiter|mit bloßem Auge|Totpunkt|Eindringtiefe|Geschlecht|Analyse|Schwanzwelle",
           "R": "Beleidigungen|Drohungen|Belästigung|Hassrede", "F": "sind verboten|werden gelöscht|sind zu melden|werden nicht geduldet"},
    "fr": {"V": "tuer|arrêter|exécuter|dénuder|graisser|serrer|frapper|toucher", "O": "le processus|la tâche|le fil|le boulon|le joint|le script", "T": "prise mâle|prise femelle|fil nu|à l'œil nu|point mort|graisseur|sexe|profondeur de pénétration|analyse", "R": "les insultes|les menaces|le harcèlement", "F": "sont interdites|seront supprimées|doit être signalé"},
    "es": {"V": "matar|abortar|ejecutar|pelar|engrasar|apretar|golpear|tocar", "O": "el proceso|la tarea|el cable|el tornillo|la junta|el script", "T": "conector macho|conector hembra|cable desnudo|a simple vista|punto muerto|engrasador|sexo|profundidad de penetración|análisis", "R": "los insultos|las amenazas|el acoso", "F": "están prohibidos|serán borrados|deben denunciarse"},
    "it": {"V": "uccidere|interrompere|eseguire|spelare|ingrassare|stringere|colpire|toccare", "O": "il processo|il lavoro|il cavo|la vite|la guarnizione|lo script", "T": "connettore maschio|connettore femmina|filo nudo|a occhio nudo|punto morto|ingrassatore|sesso|profondità di penetrazione|analisi", "R": "gli insulti|le minacce|le molestie", "F": "sono vietati|saranno cancellati|vanno segnalate"},
    "ru": {"V": "убить|прервать|выполнить|зачистить|смазать|затянуть|ударить|тронуть", "O": "процесс|задачу|провод|болт|прокладку|скрипт", "T": "разъём папа|разъём мама|голый провод|невооружённым глазом|мёртвая точка|пол мужской|глубина проникновения|анализ|член комиссии", "R": "оскорбления|угрозы|домогательства", "F": "запрещены|удаляются|недопустимы"},
}

#: Harmless lines in languages that the phrases above do not cover.
ELSEWHERE = (
    "दैनिक निरीक्षण पूरा हुआ", "पंप ठीक से चल रहा है", "لا توجد ملاحظات اليوم", "تم فحص المضخة", "点検は完了しました", "ポンプは正常", "检查已完成", "泵运行正常", "Έλεγχος ολοκληρώθηκε", "η αντλία λειτουργεί", "הבדיקה הושלמה", "점검 완료", "펌프 정상", "ตรวจสอบแล้ว",
    "przegląd pompy zakończony", "kontrola čerpadla hotová", "pompa kontrolü tamam", "pumpen kontrollerad", "controle van de pomp gereed", "a szivattyú rendben", "verificare pompă terminată", "bomba verificada sem falhas",
)

#: Letters of one script that look like those of the other, and signs typed for letters.
ALIKE = dict(zip("aceopxyAEOPCTXBHKM", "асеорхуАЕОРСТХВНКМ"))
LEET = {"a": "@4", "e": "3", "i": "1!", "o": "0", "s": "$5", "t": "7"}


def disguise(word: str, rng: np.random.Generator) -> str:
    """A word as people write it to slip past a filter."""
    if len(word) < 4:
        return word
    k, at = rng.integers(0, 9), int(rng.integers(1, len(word) - 1))
    if k == 0:
        return word[:at] + "*" * int(rng.integers(1, 3)) + word[at + 1 :]
    if k == 1:
        return "".join(LEET[c][0] if c in LEET and rng.random() < 0.7 else c for c in word)
    if k == 2:
        return word[:at] + "​" + word[at:]
    if k == 3:
        return "".join(ALIKE.get(c, c) if rng.random() < 0.5 else c for c in word)
    if k == 4:
        return rng.choice([".", "-", " "]).join(word)
    if k == 5:
        return word.upper()
    if k == 6:
        return word[:at] + word[at] * int(rng.integers(2, 5)) + word[at + 1 :]
    if k == 7:
        return word[:at] + rng.choice(["#", "_", "%"]) + word[at + 1 :]
    return word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :] if rng.random() < 0.3 else word


def _filled(frame: str, words: dict[str, str], rng: np.random.Generator, letters: str) -> str:
    """A frame with a word of the lexicon in each slot; a group is now and then one that nobody has listed."""
    while (at := frame.find("{")) >= 0:
        slot = frame[at + 1]
        word = str(rng.choice(words[slot].split("|")))
        if slot == "G" and rng.random() < 0.25:
            word = "".join(rng.choice(list(letters), int(rng.integers(5, 10))))
        frame = frame[:at] + word + frame[at + 3 :]
    return frame


def _meaningless(rng: np.random.Generator) -> str:
    """A line of another language, in order or not, of random strings, or of one character."""
    kind, letters = rng.integers(0, 4), "abcdefghijklmnopqrstuvwxyz0123456789"
    if kind < 2:
        text = str(rng.choice(ELSEWHERE))
        return " ".join(rng.permutation(text.split(" "))) if kind else text
    if kind == 2:
        return " ".join("".join(rng.choice(list(letters), int(rng.integers(1, 12)))) for _ in range(int(rng.integers(1, 6))))
    return str(rng.choice(list(letters))) * int(rng.integers(1, 40)) if rng.random() < 0.5 else letters[: int(rng.integers(1, 26))]


def seed_sentences(n: int, rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """n phrases, six in ten abusive; of those one or two, and words of two in five are disguised."""
    texts, labels = [], []
    languages = sorted(ABUSIVE)
    for i in range(n):
        language = languages[i % len(languages)]
        letters = "абвгдеиклмнорстуы" if language == "ru" else "abdeghiklmnoprstuv"
        abusive = rng.random() < 0.6
        if abusive:
            frames = ABUSIVE[language]
            text = ", ".join(_filled(str(rng.choice(frames)), LEXICON[language], rng, letters) for _ in range(1 + int(rng.random() < 0.3)))
            if rng.random() < 0.4:
                words = text.split(" ")
                long = [k for k, w in enumerate(words) if len(w) > 3]
                for k in rng.choice(long, min(len(long), 2), replace=False) if long else []:
                    words[k] = disguise(words[k], rng)
                text = " ".join(words)
        elif rng.random() < 0.3:
            text = _meaningless(rng)
        else:
            text = _filled(str(rng.choice(["{V} {O}", "{V} {O}", "{T}", "{R} {F}"])), TECHNICAL[language], rng, letters)
            if rng.random() < 0.15:
                text = " ".join(disguise(w, rng) if rng.random() < 0.15 else w for w in text.split(" "))
        labels.append(int(abusive))
        texts.append(text[:1].upper() + text[1:] + ("." if rng.random() < 0.7 else ""))
    return texts, labels
