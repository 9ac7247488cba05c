"""Personal data: every detected entity is replaced by a keyed, type-consistent surrogate.

An entity is first brought to a normal form (the digits of a phone number with its country code, of a
card, an IBAN without spaces, an address in small letters). A keyed permutation of the normal forms of
one class gives the surrogate, which is written in the way the entity was. So equal entities get equal
surrogates however they are written (coreference) and different ones different surrogates
(distinctness) without any table of entities: permutations have no collisions. The permutations are
cyclic orders of all values of a class, by a Feistel network: a surrogate is the next value that the
class admits, so it is never the original, if the class has a second value. ``checked`` holds this
against the corpus, by a collision check over all entities in Spark.

Names are found after titles, and as a listed given name with another capitalised word behind it;
their words (of two letters at least) are then replaced wherever they stand in the same text, each by
the same surrogate in any place of a name.

The key decides all surrogates and turns them back; it is a required argument.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import discard, extended, fresh, materialise, table

#: The session setting that holds the key of the query and of the pipeline.
KEY_SETTING = "spark.lattica.surrogates.key"

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): (
        "Adele Agnes Alice Amanda Amelia Andrea Angela Anna Barbara Beatrice Bianca Carla Carmen Caroline Catherine Charlotte Christina Clara Claudia Cristina Daniela Diana Dorothy Elena Elisa Elizabeth Emily Emma Eva "
        "Fiona Florence Francesca Gabriela Greta Hannah Heidi Helen Ingrid Irene Isabel Jane Janet Jennifer Jessica Johanna Judith Julia Karen Katharina Laura Lena Linda Lisa Lucia Luisa Margaret Maria Marta Martha Mary "
        "Michelle Monica Nancy Natalie Nicole Nina Olivia Patricia Paula Petra Rachel Rebecca Rosa Ruth Sabine Sandra Sarah Silvia Simone Sofia Sophie Stephanie Susan Susanne Teresa Ursula Valentina Vanessa Veronica Victoria Virginia Yvonne"
    ).split(),
    ("latin", "m"): (
        "Adam Alan Albert Alberto Alexander Alfred Andrew Anthony Antonio Arthur Benjamin Bernard Bruno Carlos Charles Christian Christopher Daniel David Dennis Diego Dominic Donald Edward Eric Ernest Felix Fernando Francis Frank "
        "Frederick Gabriel George Gerald Giovanni Gregory Hans Harold Heinrich Henry Hugo Jacob James Javier John Jonathan Joseph Juan Julian Karl Kenneth Kevin Klaus Lawrence Leon Louis Lucas Luis Marco Martin Matthew Michael Miguel Nicholas "
        "Oliver Oscar Pablo Patrick Paul Pedro Peter Philip Pierre Ralph Raymond Richard Robert Roger Samuel Sebastian Simon Stefan Stephen Theodore Thomas Timothy Tobias Victor Vincent Walter William Wolfgang"
    ).split(),
    ("cyrillic", "f"): "Алла Анастасия Анна Валентина Вера Виктория Галина Дарья Евгения Екатерина Елена Елизавета Зинаида Зоя Инна Ирина Ксения Лариса Лидия Любовь Людмила Маргарита Марина Мария Надежда Наталья Нина Оксана Ольга Полина Раиса Светлана София Софья Тамара Татьяна Ульяна Юлия Яна".split(),
    ("cyrillic", "m"): "Александр Алексей Анатолий Андрей Антон Аркадий Артём Богдан Борис Вадим Валерий Василий Виктор Виталий Владимир Вячеслав Геннадий Георгий Григорий Даниил Денис Дмитрий Евгений Иван Игорь Илья Кирилл Константин Лев Леонид Максим Михаил Никита Николай Олег Павел Пётр Роман Сергей Степан Тимофей Фёдор Юрий Яков".split(),
    ("greek", "f"): "Αγγελική Αθηνά Αικατερίνη Αλεξάνδρα Αναστασία Άννα Βασιλική Βικτώρια Γεωργία Δήμητρα Ειρήνη Ελένη Ευαγγελία Ζωή Ιωάννα Κατερίνα Κωνσταντίνα Μαρία Μαρίνα Νίκη Ουρανία Παρασκευή Σοφία Στέλλα Φωτεινή Χριστίνα".split(),
    ("greek", "m"): "Αθανάσιος Αλέξανδρος Ανδρέας Αντώνης Απόστολος Βασίλης Γιάννης Γιώργος Γρηγόρης Δημήτρης Ευάγγελος Ηλίας Θεόδωρος Ιωάννης Κώστας Λεωνίδας Μανώλης Μιχάλης Νίκος Παναγιώτης Παύλος Πέτρος Σπύρος Στέφανος Σωτήρης Χρήστος".split(),
}
_GENDERED = {name: group for group, names in GIVEN.items() for name in names}
_TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Señora Sra Sig.ra госпожа κυρία".split(), "m": "Mr Herr Monsieur Señor Sr Sig господин κύριος".split(), "": "Dr Prof".split()}
_TITLE_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}

# Country calling codes of one and two digits (ITU E.164); all others have three.
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Characters of an IBAN by country (IBAN registry).
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def key_of(spark: SparkSession) -> bytes:
    """The key in the session's setting; where none is set, a random one that lives as long as this process, so that nobody can turn the surrogates back."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _RANDOM


_RANDOM = os.urandom(32)


class Permuter:
    """Keyed cyclic orders of ranges and of format classes."""

    def __init__(self, key: bytes):
        self.key = key

    def _rounds(self, x: int, half: int, tweak: bytes, order: range) -> int:
        """A Feistel network of eight rounds over numbers of 2 * half bits; rounds from last to first undo it."""
        mask, size = (1 << half) - 1, (half + 7) // 8
        a, b = x >> half, x & mask
        if order.step < 0:
            a, b = b, a
        for i in order:
            f = hashlib.blake2b(b.to_bytes(size, "big") + bytes([i]) + tweak, key=self.key, digest_size=size).digest()
            a, b = b, a ^ (int.from_bytes(f, "big") & mask)
        if order.step < 0:
            a, b = b, a
        return a << half | b

    def number(self, x: int, n: int, tweak: str, ok: Callable[[int], bool] = lambda _: True) -> int:
        """The number after x in a keyed cyclic order of the numbers 0..n-1 that are ok (as x is): a permutation without fixed points, if there are two."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        key = hashlib.blake2b(f"{tweak}|{n}".encode(), key=self.key, digest_size=16).digest()
        place, last = self._rounds(x, half, key, range(8)), (1 << 2 * half) - 1
        while True:
            place = (place + 1) & last
            x = self._rounds(place, half, key, range(7, -1, -1))
            if x < n and ok(x):
                return x

    def spelt(self, s: str, kinds: list[str], tweak: str, ok: Callable[[str], bool] = lambda _: True) -> str:
        """Characters of each kind become others of it; all else stays. The class is the form: what stays, and the kinds."""
        kind_of = {c: k for k in kinds for c in k}
        places = [(i, kind_of[c]) for i, c in enumerate(s) if c in kind_of]
        n, x = 1, 0
        for i, k in places:
            n *= len(k)
            x = x * len(k) + k.index(s[i])

        def spell(x: int) -> str:
            out = list(s)
            for i, k in reversed(places):
                x, d = divmod(x, len(k))
                out[i] = k[d]
            return "".join(out)

        form = "".join(str(kinds.index(kind_of[c])) if c in kind_of else f"<{c}>" for c in s)
        return spell(self.number(x, n, f"{tweak}|{form}", lambda y: ok(spell(y)))) if n > 1 else s

    def text(self, s: str, tweak: str, ok: Callable[[str], bool] = lambda _: True) -> str:
        """Digits, small and capital letters each become others of their kind; all else stays."""
        return self.spelt(s, ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"], tweak, ok)


def _luhn(digits: str) -> int:
    """The digit that completes these to a valid card number."""
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _is_card(s: str) -> bool:
    """Other long numbers, whose last digit doesn't check, are left alone."""
    digits = _digits(s)
    return int(digits[-1]) == _luhn(digits[:-1])


def _card(p: Permuter, s: str) -> str:
    """Network digit and number of digits stay; the check digit is right."""
    digits = _digits(s)
    body = digits[0] + p.text(digits[1:-1], f"card{digits[0]}")
    return _into(s, body + str(_luhn(body)))


def _into(form: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), form)


def _phone(p: Permuter, s: str) -> str:
    """The country code and all punctuation stay; numbers of ten digits without a code are American ones; their area code and exchange keep a leading 2 to 9 where they have one."""
    digits, code = _digits(s), ""
    if s.startswith("+"):
        code = next((digits[:n] for n in (1, 2) if digits[:n] in _CALLING), digits[:3])
        digits = digits[len(code) :]
    elif len(digits) == 10:
        code = "1"
    leading = lambda d: [i for i in (0, 3) if code == "1" and len(d) == 10 and d[i] in "23456789"]
    must = leading(digits)
    found = p.text(digits, f"phone{code}{must}", lambda d: leading(d) == must)
    return _into(s, (code if s.startswith("+") else "") + found)


def _iban_check(country: str, account: str) -> int:
    """The two check digits, by the remainder of 97."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(p: Permuter, s: str) -> str:
    """The country, the kinds of characters and the spaces stay; a valid number gives a valid one, an invalid one an equally invalid one."""
    whole = s.replace(" ", "")
    country, check, account = whole[:2], int(whole[2:4]), whole[4:]
    off = (check - _iban_check(country, account)) % 97 if 2 <= check <= 98 else None
    account = p.text(account, f"iban{country}{check if off is None else off}")
    check = check if off is None else (_iban_check(country, account) - 2 + off) % 97 + 2
    it = iter(f"{country}{check:02d}{account}")
    return "".join(c if c == " " else next(it) for c in s)


def _kind_of_ip(a: int, b: int) -> str:
    if a in (0, 127) or a >= 224:
        return f"fixed{a}"
    return "ten" if a == 10 else "one" if (a, b) == (192, 168) else "two" if a == 172 and 16 <= b < 32 else "public"


def _ip(p: Permuter, s: str) -> str:
    """A public address gives a public one, a private one of the same block."""
    x = 0
    for part in s.split("."):
        x = x << 8 | int(part)
    kind = _kind_of_ip(x >> 24, x >> 16 & 255)
    fixed = {"ten": 24, "one": 16, "two": 20}.get(kind, 24 if kind.startswith("fixed") else 32)
    low = (1 << fixed) - 1
    y = x & ~low | p.number(x & low, 1 << fixed, f"ip{kind}", lambda v: kind != "public" or _kind_of_ip(v >> 24, v >> 16 & 255) == "public")
    return ".".join(str(y >> k & 255) for k in (24, 16, 8, 0))


def _email(p: Permuter, s: str) -> str:
    """Case does not tell addresses apart; the last label of the host stays, and the last two where they are reserved for examples."""
    local, _, host = s.lower().partition("@")
    labels = host.split(".")
    keep = 2 if labels[-2] == "example" else 1
    hidden = ".".join(labels[:-keep])
    name = p.text(f"{local}@{hidden}" if hidden else local, "email" + ".".join(labels[-keep:]), lambda s: keep == 2 or not s.endswith(("@example", ".example")))
    return (name if hidden else name + "@").rstrip(".") + ("." if hidden else "") + ".".join(labels[-keep:])


def _secret(p: Permuter, s: str) -> str:
    """Hex strings stay hex; the prefix that tells who issued a secret stays, and the kind of each other character."""
    if re.fullmatch(r"[0-9a-f]+", s):
        return f"{p.number(int(s, 16), 16 ** len(s), f'hex{len(s)}'):0{len(s)}x}"
    head = _ISSUER.match(s)[0]
    return head + p.text(s[len(head) :], f"secret{head}")


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def _name(p: Permuter, name: str) -> str:
    """A listed given name gives another of its script and gender; any other word a spelt one that is on no list, wherever in a name it stands."""
    group = _GENDERED.get(name)
    if group:
        names = GIVEN[group]
        return names[p.number(names.index(name), len(names), f"given{group}")]
    return p.spelt(name, _KINDS[_script(name)], f"name{_script(name)}", lambda w: w not in _GENDERED)


# Vowels and consonants of each script, small and capital: a spelt name can be said like the name it stands for.
_SOUNDS = {"latin": ("aeiou", "bcdfghjklmnprstvwxyz"), "cyrillic": ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"), "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
_KINDS = {script: [x for kind in kinds for x in (kind, kind.upper())] for script, kinds in _SOUNDS.items()}


_LETTER = r"[^\W\d_]"
_CAPITAL = rf"(?=[^\W\d_a-z]){_LETTER}+"
_TITLE = "|".join(sorted(map(re.escape, _TITLE_GENDER), key=len, reverse=True))
_LISTED = "|".join(sorted(_GENDERED, key=lambda w: (-len(w), w)))
_NAME = rf"(?<!\w)(?:(?:{_TITLE})\.? (?P<named>{_CAPITAL}(?: {_CAPITAL})?)|(?P<untitled>(?:{_LISTED}) [A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я][^\W\d_A-ZΆ-ΫЀ-Я]+))(?!\w)"
_IBANS = "|".join(rf"(?:{'|'.join(c.split())})\d\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN.items())
_ISSUED = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|AIza[A-Za-z0-9_-]{35}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,90}|glpat-[A-Za-z0-9_-]{20,}|xox[abposr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|hf_[A-Za-z0-9]{30,}|npm_[A-Za-z0-9]{36}"
_ISSUER = re.compile(r"AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abposr]-|sk-(?:proj-|ant-|svcacct-)?|[sr]k_(?:live|test)_|hf_|npm_")
_PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,}",
    "issued": rf"(?<![A-Za-z0-9_-])(?:{_ISSUED})(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9_-])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": rf"(?<!\w)(?=[A-Z][A-Z]\d\d)(?:{_IBANS})(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w])(?!\.\d)",
}
_DIGIT = re.compile("[0-9]")
_ISSUERS = "AKIA ASIA AIza ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xox sk- k_live_ k_test_ hf_ npm_".split()
_NAMES = re.compile(_NAME)
_RUN = re.compile(r"\w+")
_NAME_HINTS = frozenset(_GENDERED) | {_RUN.match(t)[0] for t in _TITLE_GENDER}


@lru_cache(maxsize=None)
def _any(kinds: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{_PATTERNS[k]})" for k in kinds))


_HOW = {"email": _email, "issued": _secret, "hex": _secret, "phone": _phone, "card": _card, "ip": _ip, "iban": _iban, "ssn": lambda p, s: p.text(s, "ssn")}


def normal(kind: str, s: str) -> str:
    """What is the same in every writing of an entity."""
    if kind == "phone":
        digits = _digits(s)
        return f"+{digits}" if s.startswith("+") else f"+1{digits}" if len(digits) == 10 else digits
    return s.lower() if kind == "email" else _digits(s) if kind == "card" else s.replace(" ", "") if kind == "iban" else s


def replace(text: str, p: Permuter) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, original, surrogate) of each entity in order; a name has one for each word."""
    found: list[tuple[str, str, str]] = []

    def entity(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "card" and not _is_card(m[0]):
            return m[0]
        out = _HOW[kind](p, m[0])
        found.append(("secret" if kind in ("issued", "hex") else kind, m[0], out))
        return out

    def named(m: re.Match) -> str:
        at = m.start("named") if m["named"] else m.start()
        words = m.string[at : m.end()].split(" ")
        out = [_name(p, w) for w in words]
        found.extend(("name", *x) for x in zip(words, out))
        return m.string[m.start() : at] + " ".join(out)

    # a pattern is tried only on texts that hold what every match of it holds
    digits = _DIGIT.search(text) is not None
    kinds = tuple(k for k in _PATTERNS if ("@" in text if k == "email" else any(x in text for x in _ISSUERS) if k == "issued" else digits))
    if kinds:
        text = _any(kinds).sub(entity, text)
    if not _NAME_HINTS.isdisjoint(_RUN.findall(text)):
        words = {w for m in _NAMES.finditer(text) for w in (m["named"] or m["untitled"]).split(" ") if len(w) > 1}
        if words:
            again = "|".join(sorted(map(re.escape, words), key=len, reverse=True))
            text = re.sub(rf"{_NAME}|(?<!\w)(?:{again})(?: (?:{again}))*(?!\w)", named, text)
        else:
            text = _NAMES.sub(named, text)
    return text, found


_ADDED = ("n_entities", "entities")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """The input's columns with surrogates in the text, n_entities and entities (type, original, surrogate).

    Null texts stay null, empty ones empty; both have no entities. Rows stay in their partitions; equal
    rows get equal results, whatever task they are in. Long texts are taken whole. Input columns named
    n_entities or entities are replaced. An empty table gives an empty result.
    """
    docs = fresh(docs, *_ADDED)
    if not key:
        raise ValueError("a key is needed")
    secret = hmac.new(key, b"surrogates", "sha256").digest()

    def start():
        p = Permuter(secret)

        def work(texts: list[str | None]) -> dict[str, list]:
            found = [(None, []) if t is None else replace(t, p) for t in texts]
            return {
                "text": [t for t, _ in found],
                "n_entities": [len(e) for _, e in found],
                "entities": [[{"type": a, "original": normal(a, b), "surrogate": normal(a, c)} for a, b, c in e] for _, e in found],
            }

        return work

    names = docs.columns
    return extended(docs, ["text"], start, "text string, n_entities bigint, entities array<struct<type:string,original:string,surrogate:string>>").select(*names, *_ADDED)


def checked(docs: DataFrame, key: bytes, attempts: int = 3) -> DataFrame:
    """``pseudonymise``, written to the shared folder, after a check of all entities for collisions.

    Permutations have none. Should there be one all the same (two keyed classes that overlap), all is
    done again with another key that is derived from this one; after ``attempts`` it is an error.
    """
    for nr in range(attempts):
        found = materialise(pseudonymise(docs, hmac.new(key, str(nr).encode(), "sha256").digest()), "surrogates")
        if not collisions(found).limit(1).count():
            return found
        discard(found)
    raise RuntimeError("surrogates collide under every key tried")


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for two entities, entities with two surrogates, and entities that are their own surrogate; a correct run has none.

    Entities are compared in their normal form. Equal entities are counted once before they are dealt out.
    """
    e = found.where("n_entities > 0").select(F.explode("entities").alias("e")).select("e.type", "e.original", "e.surrogate").distinct()
    twice = e.groupBy("type", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("type", F.col("surrogate").alias("value"), F.lit("surrogate").alias("side"))
    split = e.groupBy("type", "original").agg(F.count("*").alias("n")).where("n > 1").select("type", F.col("original").alias("value"), F.lit("original").alias("side"))
    same = e.where(F.col("original") == F.col("surrogate")).select("type", F.col("original").alias("value"), F.lit("same").alias("side"))
    return twice.unionByName(split).unionByName(same)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checked(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return found.select("doc_id", "text", "n_entities", F.array_join(F.sort_array(F.array_distinct(F.col("entities.type"))), ",").alias("types"))
