"""Personal data: detected entities are replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import hmac
import re
import string
from bisect import bisect
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm.common import cut, release_memory, table

KEY = "surrogates-1"
LENGTHEN_EVERY = 8

# Forms of address with the gender they tell ("" where they tell none).
ADDRESSES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f",
             "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Don": "m", "Doña": "f",
             "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
# Given names by script and gender.
GIVEN_NAMES = {
    ("latin", "m"): "Adam Albert Andrew Anthony Benjamin Carlos Charles Christopher Daniel David Diego Edward Felix "
                    "Francis Frederick George Hans Henry Hugo Jacques James Javier John Jonathan Joseph Juan Julian Karl "
                    "Kevin Klaus Louis Lucas Luis Manuel Mark Martin Matthew Michael Miguel Nicholas Oliver Oscar "
                    "Patrick Paul Pedro Peter Philip Pierre Richard Robert Samuel Simon Stefan Steven Theodore Thomas "
                    "Victor Vincent Walter William".split(),
    ("latin", "f"): "Alice Amelia Andrea Angela Anna Barbara Beatrice Camille Carmen Caroline Catherine Charlotte Clara "
                    "Claudia Diana Elena Eleanor Elizabeth Emily Emma Eva Fiona Florence Gabriela Grace Greta Hannah "
                    "Helen Ingrid Irene Isabel Jane Jennifer Jessica Julia Karen Laura Linda Lucy Margaret Maria "
                    "Marie Martha Mary Monica Nancy Natalie Nicole Olivia Patricia Rachel Rebecca Rosa Ruth Sandra "
                    "Sarah Sofia Susan Teresa Ursula Victoria".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Евгений Иван Михаил Николай Олег Павел "
                       "Пётр Сергей Юрий".split(),
    ("cyrillic", "f"): "Александра Анна Валентина Вера Галина Екатерина Елена Ирина Людмила Мария Наталья Ольга "
                       "Светлана Софья Татьяна Юлия".split(),
    ("greek", "m"): "Αλέξανδρος Ανδρέας Αντώνης Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Πέτρος Σπύρος Στέφανος".split(),
    ("greek", "f"): "Αγγελική Αικατερίνη Άννα Βασιλική Δήμητρα Ειρήνη Ελένη Ευαγγελία Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
# Beginnings and ends from which surnames are put together.
SURNAMES = {
    "latin": ("Al Ash Bar Ben Black Brad Brook Cald Car Col Dal Dun East Ed Fair Far Gar Glen Gran Hal Har Hol Kirk Lang "
              "Lin Mar Mel Nor Oak Pres Rad Rich Rock Sel Shel Stan Sut Thorn Wal Wes Whit Win Wood".split(),
              "bert bridge bury by combe cott den don dale field ford gate ham hurst land ley low man mere mont more ridge "
              "son stead ston stock ton ville water well wick wood worth".split()),
    "cyrillic": ("Бел Бор Волк Гор Дуб Зим Кар Кот Лебед Мор Ник Орл Пав Рыб Сокол Степ Тих Фад Чер Шир".split(),
                 "аев енко ёв ин ович овский ухин цов чук янов".split()),
    "greek": ("Αλεξ Αναστ Βασιλ Γεωργ Δημ Θεοδ Ιωανν Κωνστ Λαμπρ Μιχ Νικολ Παπ Πετρ Σταμ Χριστ".split(),
              "άκης αδόπουλος ακόπουλος ίδης ιάδης όπουλος ούλης ιώτης".split()),
}

EMAIL = re.compile(r"(?<![\w.%+-])([\w%+-]+(?:\.[\w%+-]+)*)@((?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})")
# Between the parts of a number stands a separator, and in damaged texts up to three symbols after each word.
_GAP = r"[^\w\s(+]{0,3}[ .-]?"
NUMBER = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    rf"|(?P<phone>\+\d{{1,3}}{_GAP}(?:\(\d{{1,4}}\){_GAP})?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}"
    rf"|\(\d{{3}}\){_GAP}\d{{3}}[ .-]\d{{4}}"
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\w)"
    r"|(?P<card>\d{4}(?:[ -]?\d{4}){2}(?:[ -]?\d{1,7})|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w))")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS_KEY = re.compile(r"(?<!\w)(AKIA|ASIA)([A-Z0-9]{16})(?!\w)")
SECRET = re.compile(r"""(?i)\b(?:token|password|passwd|secret|api_?key)[^\w\s]*\s*[=:][^\w\s]*\s*["']?((?=[_+/-]*[0-9a-z])[0-9a-z_+/-]{8,})(?![\w+/-])""")
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
NAME = re.compile(rf"(?<!\w){_NAME}")
POSSESSIVE = re.compile(r"['’][sS]$")
# Each form also stands in capitals.
ADDRESSES |= {a.upper(): gender for a, gender in ADDRESSES.items()}
GENDERS = {form: gender for (_, gender), names in GIVEN_NAMES.items() for name in names for form in (name, name.upper())}
ADDRESSED = re.compile(rf"(?<!\w)({'|'.join(sorted(ADDRESSES, key=len, reverse=True))})(?=\.? ({_NAME})(?: ({_NAME}))?(?: ({_NAME}))?)")
GIVEN = re.compile(rf"(?<!\w)({'|'.join(sorted(GENDERS, key=len, reverse=True))}) ({_NAME})")
# Texts without a digit, or without a capitalised word that is known, need no closer look for numbers or names.
DIGIT = re.compile(r"\d")
CAPITALISED = re.compile(r"[A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я]\w+")
KNOWN_WORDS = frozenset(GENDERS) | frozenset(ADDRESSES)

Mention = tuple[int, int, str, str]  # start, stop, kind, value; the value is the same however it is written


def luhn_rest(digits: str) -> int:
    twice = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(x - 9 * (x > 9) for x in twice) % 10


def iban_rest(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def script_of(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def _numbers(text: str) -> Iterator[Mention]:
    for m in NUMBER.finditer(text):
        kind, found = m.lastgroup, m.group()
        digits = re.sub(r"\D", "", found)
        if kind == "ip":
            if all(int(x) <= 255 for x in found.split(".")):
                yield *m.span(), "ip", ".".join(str(int(x)) for x in found.split("."))
        elif kind == "ssn":
            yield *m.span(), "ssn", digits
        elif kind == "phone" and 7 <= len(digits) <= 15:
            yield *m.span(), "phone", digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        elif kind == "card" and 13 <= len(digits) <= 19 and luhn_rest(digits) == 0 and len(set(digits)) > 1:
            yield *m.span(), "card", digits


def _in_capitals(word: str) -> bool:
    return len(word) > 1 and word.isupper()


def _name(text: str, start: int, stop: int, kind: str) -> Mention:
    """The mention of a name, without the ending of a possessive."""
    word = POSSESSIVE.sub("", text[start:stop])
    return start, start + len(word), f"{kind}:{script_of(word)}", word.casefold()


def _names(text: str) -> Iterator[Mention]:
    """Names after a form of address or begun by a given name; a possessive ends a name."""
    for m in ADDRESSED.finditer(text):
        words = []
        for i in (2, 3, 4):
            word = m.group(i)
            if not word or word in ADDRESSES or not word[0].isupper() or _in_capitals(m.group(1)) and not _in_capitals(word):
                break
            words.append(i)
            if POSSESSIVE.search(word):
                break
        gender = ADDRESSES[m.group(1)]
        for i in words:
            if i == words[-1]:
                yield _name(text, *m.span(i), "surname")
            else:
                start, stop, kind, value = _name(text, *m.span(i), "given")
                yield start, stop, f"{kind}:{GENDERS.get(m.group(i)) or gender or 'f'}", value
    for m in GIVEN.finditer(text):
        word, other = m.groups()
        if other[0].isupper() and (not _in_capitals(word) or _in_capitals(other)):
            yield *m.span(1), f"given:{script_of(word)}:{GENDERS[word]}", word.casefold()
            yield _name(text, *m.span(2), "surname")


def _bare_names(text: str, names: list[Mention], taken: list[tuple[int, int]]) -> Iterator[Mention]:
    """Mentions outside ``taken`` (in order) of single words of ``names``, those in capitals of any, others of names so written."""
    kinds: dict[tuple[bool, str], tuple[str, str]] = {}
    for start, stop, kind, value in names:
        for capitals in {True, _in_capitals(text[start:stop])}:
            kinds.setdefault((capitals, value), (kind, value))
    for m in NAME.finditer(text):
        word = POSSESSIVE.sub("", m.group())
        found = kinds.get((_in_capitals(word), word.casefold())) if word[0].isupper() else None
        if found:
            start, stop = m.start(), m.start() + len(word)
            at = bisect(taken, (start, stop))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= stop):
                yield start, stop, *found


def find_mentions(text: str | None) -> list[Mention]:
    """Entities of a whole text in order; of overlapping finds the earlier kind in this list counts.

    The words of a name found once are its mentions wherever else they stand alone in the text.
    """
    text = text or ""
    found: list[Mention] = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            domain = m.group(2).lower()
            found.append((*m.span(1), f"mailbox:{domain}", m.group(1).lower()))
            found.append((*m.span(2), "domain", domain))
    if "AKIA" in text or "ASIA" in text:
        found += [(*m.span(2), "access_key", m.group(2)) for m in ACCESS_KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret", m.group(1)) for m in SECRET.finditer(text)]
    if DIGIT.search(text):
        found += [(*m.span(), "iban", v) for m in IBAN.finditer(text) if iban_rest(v := m.group().replace(" ", "")) == 1]
        found += _numbers(text)
    if not KNOWN_WORDS.isdisjoint(CAPITALISED.findall(text)):
        found += _names(text)
    taken, out = [], []
    for mention in found:
        if all(mention[1] <= a or mention[0] >= b for a, b in taken):
            taken.append(mention[:2])
            out.append(mention)
    names = sorted(m for m in out if m[2].startswith(("given:", "surname:")))
    if names:
        out += list(_bare_names(text, names, sorted(taken)))
    return sorted(out)


class Stream:
    """Keyed numbers without end: a function of the key, the kind, the value and the attempt."""

    def __init__(self, key: str, kind: str, value: str, attempt: int):
        self.message, self.n = "\0".join((kind, value, str(attempt))).encode(), 0
        self.key, self.state = key.encode(), 0

    def below(self, n: int) -> int:
        if self.state < 1 << 64:
            block = hmac.new(self.key, self.message + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.state, self.n = int.from_bytes(block, "big") | 1 << 256, self.n + 1
        self.state, out = divmod(self.state, n)
        return out

    def pick(self, options):
        return options[self.below(len(options))]


def _alike(stream: Stream, value: str) -> str:
    """Digits for digits, small letters for small, capitals for capitals; hexadecimal stays hexadecimal."""
    small, big = string.ascii_lowercase, string.ascii_uppercase
    if re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", value) and not value.isdigit():
        small, big = "abcdef", "ABCDEF"
    return "".join(stream.pick(string.digits) if c.isdigit() else stream.pick(big) if c.isupper()
                   else stream.pick(small) if c.isalpha() else c for c in value)


def _more(stream: Stream, n: int) -> str:
    return "".join(stream.pick(string.digits) for _ in range(n))


def _octet(stream: Stream, octet: str, first: bool) -> str:
    low, high = {1: (1 if first else 0, 9), 2: (11, 99), 3: (128, 191) if first else (100, 255)}[len(octet)]
    return str(low + stream.below(high - low + 1))


def surrogate(key: str, kind: str, value: str, attempt: int) -> str:
    """A replacement in the value's own type and format; each attempt gives another.

    Later attempts draw from more and more values, so that no kind runs out of them: names and mailboxes grow
    first; addresses take octets of any length, then any class, then more octets; numbers and secrets get digits.
    """
    stream = Stream(key, kind, value, attempt)
    longer = attempt // LENGTHEN_EVERY
    extra = max(0, longer - 1)
    name, _, detail = kind.partition(":")
    if name == "given":
        script, gender = detail.split(":")
        return "-".join(stream.pick(GIVEN_NAMES[script, gender]) for _ in range(1 + longer))
    if name == "surname":
        begin, end = SURNAMES[detail]
        return "-".join(stream.pick(begin) + stream.pick(end) for _ in range(1 + longer))
    if name == "mailbox":
        return _alike(stream, value) + "".join(stream.pick(string.ascii_lowercase) for _ in range(longer))
    if name == "domain":
        labels = value.split(".")
        reserved = [x for x in labels[-2:] if x in ("example", "com", "net", "org")]
        tail = ".".join(["example", reserved[-1] if reserved and reserved[-1] != "example" else "org"])
        head = labels[:-2] if labels[-2] == "example" and len(labels) > 2 else labels[:-1]
        return ".".join([_alike(stream, x) + "".join(stream.pick(string.ascii_lowercase) for _ in range(longer))
                         for x in head] + [tail])
    if name == "ip":
        octets = value.split(".")
        kept = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] or (
            octets[0] == "172" and 16 <= int(octets[1]) <= 31) else 0
        if longer > 2:
            return ".".join(str(stream.below(256)) for _ in range(max(4, longer - 2)))
        lengths = [stream.pick(("0", "00", "000")) if longer else x for x in octets]
        return ".".join(x if i < kept else _octet(stream, lengths[i], i == 0) for i, x in enumerate(octets))
    if name == "ssn":
        return f"9{_alike(stream, value[1:])}" + _more(stream, extra)  # no number beginning with 9 is ever given out
    if name == "phone":
        if len(value) == 10 and value[3:6] == "555":  # the exchange kept for made-up numbers stays
            return stream.pick("23456789") + _alike(stream, value[1:3]) + "555" + _alike(stream, value[6:]) + _more(stream, extra)
        start = value[:-7] if len(value) > 10 else ""
        return start + (stream.pick("23456789") if value[len(start)] > "1" else value[len(start)]) + _alike(
            stream, value[len(start) + 1:]) + _more(stream, extra)
    if name == "card":
        digits = value[0] + _alike(stream, value[1:-1]) + _more(stream, extra) + "0"
        return digits[:-1] + str(-luhn_rest(digits) % 10)
    if name == "iban":
        body = value[:2] + "00" + _alike(stream, value[4:]) + _more(stream, extra)
        return f"{body[:2]}{98 - iban_rest(body):02d}{body[4:]}"
    return _alike(stream, value) + _more(stream, extra)


def written_like(kind: str, original: str, new: str) -> str:
    """``new`` in the layout of the mention: its separators, its capitals; what is longer stands at the end."""
    name = kind.partition(":")[0]
    if name in ("phone", "card", "ssn", "iban"):
        own = "".join(c for c in original if c.isalnum())
        size = len(own) - (name == "phone" and len(own) == 11 and own[0] == "1")
        out, rest = [new[size:]], list(new[:size])
        for c in reversed(original):
            out.append(rest.pop() if c.isalnum() and rest else c)
        return "".join(reversed(out))
    if name in ("given", "surname", "mailbox", "domain") and len(original) > 1 and original.isupper():
        return new.upper()
    return new


def mentions(text: Column) -> Column:
    """The distinct entities of a text as (kind, value)."""

    @F.arrow_udf("array<struct<kind: string, value: string>>")
    def run(texts: pa.Array) -> pa.Array:
        found = [sorted({m[2:] for m in find_mentions(t.as_py())}) for t in texts]
        release_memory()
        return pa.array([[{"kind": k, "value": v} for k, v in f] for f in found],
                        pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))

    return run(text)


def replaced(text: Column, known: Column) -> Column:
    """The text with every entity replaced by its surrogate from ``known``, a list of (kind, value, surrogate)."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for t, pairs in zip(texts, known):
            t, at, parts = t.as_py(), 0, []
            new = {(p["kind"], p["value"]): p["surrogate"] for p in pairs.as_py() or []}
            for start, stop, kind, value in find_mentions(t):
                parts += [t[at:start], written_like(kind, t[start:stop], new[kind, value])]
                at = stop
            out.append(None if t is None else "".join(parts) + t[at:])
        release_memory()
        return pa.array(out, pa.string())

    return run(text, known)


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, surrogate) for distinct ``entities`` (kind, value): no two values of a kind share a surrogate.

    A surrogate is refused when it is a value of its kind in the data or another value holds it; of
    several that want the same one the smallest value gets it.  The refused try again with the next keyed
    attempt, which draws from more values, until none is left.  The outcome depends on the set of entities and the key alone.
    """
    entities = cut(entities, "pii-entities")

    @F.arrow_udf("string")
    def make(kind: pa.Array, value: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *x) for x in zip(kind.to_pylist(), value.to_pylist(), attempt.to_pylist())], pa.string())

    pending, done = entities, None
    for attempt in count():
        # Compared without regard to case, as values are.
        tried = cut(pending.withColumn("surrogate", make("kind", "value", F.lit(attempt))).withColumn("plain", F.lower("surrogate")), "pii-tried")
        real = entities.select("kind", F.lower("value").alias("plain"))
        free = tried.join(real, ["kind", "plain"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "plain"), ["kind", "plain"], "left_anti")
        won = free.groupBy("kind", "plain").agg(F.min("value").alias("value"), F.min_by("surrogate", "value").alias("surrogate"))
        won = cut(won.select("kind", "value", "surrogate", "plain"), "pii-won")
        done = won if done is None else cut(done.unionByName(won), "pii-done")
        pending = cut(tried.join(won, ["kind", "value"], "left_anti").select("kind", "value"), "pii-pending")
        if pending.isEmpty():
            return done.drop("plain")


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY, number: str | None = "entities") -> DataFrame:
    """``docs``, all columns and rows, with the entities of ``text`` replaced, and ``number``, how many there were.

    One entity has one surrogate in all documents, in the layout of each mention; different entities of a kind
    have different ones, none of which is an entity of the data.  Texts without entities, null and empty
    ones are unchanged.  Only texts with entities are shuffled, by digest; copies share one list of surrogates.
    A column named ``number`` is replaced; with None no column is added, and a caller's own stay whatever their names.
    """
    rows = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"), F.size(mentions(F.col(text))).alias("__found"))
    digest = F.sha2(F.col("__text"), 256)
    marks = cut(docs.select(F.col(text).alias("__text")).select(digest.alias("__digest"), F.explode(mentions(F.col("__text"))).alias("m"))
                .select("__digest", "m.kind", "m.value").distinct(), "pii-marks")
    given = assign(marks.select("kind", "value").distinct(), key)
    lists = cut(marks.join(given, ["kind", "value"]).groupBy("__digest").agg(
        F.collect_list(F.struct("kind", "value", "surrogate")).alias("__known")), "pii-lists")
    some = rows.filter("__found > 0").withColumn("__digest", digest).join(lists, "__digest").withColumn(
        "__text", replaced(F.col("__text"), F.col("__known")))
    names = [F.col("__text").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != number]
    names += [F.col("__found").alias(number)] if number else []
    return rows.filter("__found <= 0").select(*names).unionByName(some.select(*names))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "text", "entities")
