r"""Surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail addresses, IBANs, IPv4 addresses, telephone numbers, social security numbers, card numbers and
persons (a title, a phrase that introduces a name, or a known given name, with names after it). Every entity gets a keyed
replacement of its own type: digits for digits and letters for letters of the same script, separators kept, country codes
kept, octets in range, card numbers valid by Luhn and IBANs by modulo 97 exactly if the original is; given names of the
same gender and script, surnames of the same script. The parts of a name are replaced each by itself, whatever stands
before it, so "Ms Anna Berg", "Dr Anna Berg" and "Ms Berg" still speak of one person; a name part that stands alone in a
text that names the person in full is replaced too. The gender of a given name comes from the list of names, else from
the titles it is found with anywhere; where those disagree, or say nothing, it is open.

Distinctness is checked over the whole corpus: distinct entities of a kind get distinct surrogates, and no surrogate
equals an entity that stands in the corpus; losers try again with the next attempt until none is left. After ``PATIENCE``
attempts the format is widened step by step (more letters or digits, a larger block of addresses), so that the attempts
end even if a format has fewer members than the corpus has entities. The same entity gets the same surrogate in every
document, and the same key gives the same surrogates again on the same corpus.

Defined cases: a null text stays null with no entity; a text without entities is returned byte for byte. Repeated rows
are each treated, alike. A null doc_id stays null. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

# Titles by gender, phrases that introduce a name, given names by gender and script, and the syllables and
# letters that new names are made of.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "u": ["Dr", "Prof"]}
CUES = ["y name is", "ame:", "ontact:", "ttn:", "Dear", "incerely,", "egards,", "igned by", "ritten by", "uthor:"]  # without their first letter, capital or not
GIVEN = {
    ("f", "latin"): ["Anna", "Maria", "Julia", "Laura", "Emma", "Sophie", "Clara", "Elena", "Sarah", "Alice", "Nora", "Helen", "Ruth", "Ingrid", "Camille", "Lucia", "Paula", "Marta", "Irene", "Teresa", "Greta", "Priya", "Astrid", "Amina", "Fatima", "Aisha", "Leila", "Yuki", "Mei", "Chiara", "Giulia", "Francesca", "Isabel", "Carmen", "Karin", "Birgit", "Monika", "Petra", "Susan", "Karen", "Linda", "Barbara", "Jennifer", "Jessica", "Elizabeth", "Margaret", "Emily", "Olivia", "Charlotte", "Amélie", "Chloé", "Zoé"],
    ("m", "latin"): ["John", "Peter", "Michael", "Thomas", "Paul", "David", "Daniel", "Martin", "Robert", "James", "Carlos", "Pablo", "Pierre", "Louis", "Hans", "Karl", "Stefan", "Victor", "Oscar", "Simon", "William", "George", "Charles", "Henry", "Edward", "Joseph", "Richard", "Steven", "Kevin", "Brian", "Ahmed", "Mohammed", "Omar", "Hassan", "Raj", "Arjun", "Wei", "Hiroshi", "Kenji", "Lars", "Sven", "Erik", "Jürgen", "Klaus", "Wolfgang", "Giovanni", "Marco", "Luca", "Antoine", "François", "Miguel", "Javier"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Татьяна", "Наталья", "Светлана"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"],
    ("f", "greek"): ["Μαρία", "Ελένη", "Αικατερίνη", "Σοφία", "Άννα", "Δήμητρα"],
    ("m", "greek"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Παύλος"],
}
SYLLABLES = {
    "latin": ["ber", "dal", "fel", "gar", "hol", "kan", "lin", "mar", "nor", "per", "ros", "sel", "tor", "val", "wen", "zim"],
    "cyrillic": ["бор", "вол", "гор", "дар", "зим", "кор", "лес", "мор", "нов", "пол", "рад", "сол", "тих", "хол", "чер", "яр"],
    "greek": ["παπ", "γερ", "δημ", "καλ", "λαμ", "μαρ", "νικ", "πετ", "ραλ", "σαρ", "τσα", "φιλ"],
}
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    "hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
    "katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    "hangul": "가나다라마바사아자차카타파하강남동명민서성수영우",
    "han": "王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗明华伟芳",
}
PATIENCE = 6


def _trie(words: list[str]) -> str:
    """A pattern of the words that looks at every letter once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    parts = []
    for head, tails in heads.items():
        rest = _trie([t for t in tails if t]) if any(tails) else ""
        optional = "?" if "" in tails and rest else ""
        parts.append(re.escape(head) + (f"(?:{rest}){optional}" if rest else ""))
    return "|".join(parts)


_TITLE_WORDS = [t for ts in TITLES.values() for t in ts]
_GIVEN_WORDS = [n for ns in GIVEN.values() for n in ns]
_ANY_TITLE, _ANY_GIVEN = _trie(_TITLE_WORDS), _trie(_GIVEN_WORDS)
_AFTER_CUE = rf"(?<=(?:{'|'.join(CUES)}) )"
_NAME = r"(?:\p{Lu}[\p{L}'’-]+|\p{Lo}[\p{L}\p{M}]*)"
# Each pattern begins with the characters it can begin with, so that other places of a text cost one test.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "iban": r"(?=[A-Z]{2}\d)(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv4": r"(?=\d)(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"(?=[\d+(])(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<![\p{L}\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\p{L}\d-])",
    "person": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:{_ANY_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}|{_AFTER_CUE}{_NAME}(?: {_NAME}){{1,2}}|(?:{_ANY_GIVEN})(?: {_NAME}){{1,2}})",
}
FOUND = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of this cannot hold an entity.
HINT = rf"[0-9@]|(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:{_trie(_TITLE_WORDS + _GIVEN_WORDS)}|{_AFTER_CUE})"
_PART = "array<struct<kind:string,value:string,gender:string>>"
_WORD = r"(\p{L}[\p{L}\p{M}'’-]*)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it in body."""
    return F.transform(F.array(value), body)[0]


def mentions(text: Column) -> Column:
    """All entities of a text, in order, repeats included."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text.rlike(HINT), F.lit(False)), F.regexp_extract_all(text, F.lit(f"({FOUND})"), F.lit(1))).otherwise(none)


def _kind(m: Column) -> Column:
    out = F.lit("person")
    for kind in reversed([k for k in PATTERNS if k != "person"]):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _title(m: Column) -> Column:
    """The title before the names of a person, or nothing."""
    return F.regexp_extract(m, rf"^((?:{_ANY_TITLE})\.? )", 1)


def _gender(title: Column) -> Column:
    bare = F.regexp_extract(title, rf"({_ANY_TITLE})\.? $", 1)
    return F.when(bare.isin(TITLES["f"]), F.lit("f")).when(bare.isin(TITLES["m"]), F.lit("m")).otherwise(F.lit("u"))


def parts(m: Column) -> Column:
    """What of an entity is replaced as one: a name's parts, with the gender of the title, any other entity as a whole."""
    title = _title(m)
    names = F.split(F.substring(m, F.length(title) + 1, F.length(m)), " ")
    part = lambda kind, value, gender: F.struct(kind.alias("kind"), value.alias("value"), gender.alias("gender"))
    person = F.transform(names, lambda x, i: part(F.when(i == F.size(names) - 1, F.lit("surname")).otherwise(F.lit("given")), x, _gender(title)))
    return F.when(_kind(m) == "person", person).otherwise(F.array(part(_kind(m), m, F.lit("u")))).cast(_PART)


def _given_gender(value: Column, low: Column, high: Column) -> Column:
    """Of a given name: the list's, else that of its titles (the least and the greatest that are not open)."""
    known = F.when(low == high, low).otherwise(F.lit("u"))
    for g in ("f", "m"):
        known = F.when(value.isin([n for (x, _), names in GIVEN.items() if x == g for n in names]), F.lit(g)).otherwise(known)
    return F.coalesce(known, F.lit("u"))


_SCRIPTS = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "arabic": "IsArabic", "hebrew": "IsHebrew", "devanagari": "IsDevanagari", "hiragana": "IsHiragana", "katakana": "IsKatakana", "hangul": "IsHangul", "han": "IsHan"}


def _script(x: Column) -> Column:
    out = F.lit("latin")
    for name, block in reversed(_SCRIPTS.items()):
        out = F.when(x.rlike(rf"\p{{{block}}}"), F.lit(name)).otherwise(out)
    return out


def _draw(seed: Column, i: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def _pick(items: list[str], seed: Column, i: Column | int) -> Column:
    return F.split(F.lit("|".join(items)), r"\|")[_draw(seed, i, len(items))]


def _like(value: Column, seed: Column) -> Column:
    """Letters of the same script and case for letters, digits for digits, everything else as it stands."""

    def one(c: Column, i: Column) -> Column:
        letters = F.lit(ALPHABETS["latin"])
        for name, block in reversed(_SCRIPTS.items()):
            letters = F.when(c.rlike(rf"^\p{{{block}}}$"), F.lit(ALPHABETS[name])).otherwise(letters)
        letters = F.when(c.rlike("^[A-Za-z]$"), F.lit(ALPHABETS["latin"])).otherwise(letters)
        letter = _let(letters, lambda a: F.substring(a, F.pmod(F.xxhash64(seed, i), F.length(a)).cast("int") + 1, F.lit(1)))
        return F.when(c.rlike(r"^\d$"), _draw(seed, i, 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _more(attempt: Column, seed: Column, items: list[str]) -> Column:
    """Nothing for the first PATIENCE attempts, then one item more with each."""
    extra = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), attempt - PATIENCE + 1).cast("int")), lambda i: _pick(items, seed, i + 1000))
    return F.when(attempt >= PATIENCE, F.array_join(extra, "")).otherwise(F.lit(""))


def _luhn(digits: Column) -> Column:
    """Sum of a string of digits by Luhn, the last one undoubled."""
    n = F.length(digits)
    d = F.transform(F.split(digits, ""), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _card(value: Column, like: Column, seed: Column, more: Column) -> Column:
    fresh = F.concat(F.when(value.startswith("0"), "0").otherwise((_draw(seed, -1, 9) + 1).cast("string")), F.substring(like, 2, 99), more)

    def closed(x: Column) -> Column:
        digits = F.regexp_replace(x, r"\D", "")
        check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))), F.lit(10)), F.lit(10))
        valid = F.pmod(_luhn(F.regexp_replace(value, r"\D", "")), F.lit(10)) == 0
        # An invalid number stays invalid: its last digit is any but the check digit.
        last = _let(check, lambda c: F.when(valid, c).otherwise(F.pmod(c + 1 + _draw(seed, -2, 9), F.lit(10))))
        return F.concat(F.substring(x, F.lit(1), F.length(x) - 1), last.cast("string"))

    return _let(fresh, closed)


def _mod97(x: Column) -> Column:
    """Letters as two digits (A = 10), the whole as a number modulo 97."""
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.pmod(a * 10 + (F.ascii(c) - 48), F.lit(97))).otherwise(F.pmod(a * 100 + (F.ascii(c) - 55), F.lit(97)))
    return F.aggregate(F.split(F.regexp_replace(x, " ", ""), ""), F.lit(0), step)


def _iban(value: Column, like: Column, seed: Column, more: Column) -> Column:
    country = F.substring(value, 1, 2)
    old = _mod97(F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4)))

    def closed(rest: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(rest, country, F.lit("00")))  # 2 to 98
        # An invalid number stays invalid: its check digits are any of the other 96.
        digits = _let(check, lambda c: F.when(old == 1, c).otherwise(F.lit(2) + F.pmod(c - 2 + 1 + _draw(seed, -3, 96), F.lit(97))))
        return F.concat(country, F.lpad(digits.cast("string"), 2, "0"), rest)

    return _let(F.concat(like, more), closed)


def _name(kind: Column, gender: Column, value: Column, like: Column, seed: Column, attempt: Column) -> Column:
    def given(s: str) -> Column:
        f, m = GIVEN["f", s], GIVEN["m", s]
        pick = lambda i: F.when(gender == "f", _pick(f, seed, i)).when(gender == "m", _pick(m, seed, i)).otherwise(_pick(f + m, seed, i))
        double = F.concat(pick(1), F.lit("-"), pick(2))
        return F.when(attempt < 3, pick(1)).when(attempt < 8, double).otherwise(F.concat(double, F.lit("-"), F.initcap(surname(s))))

    def surname(s: str) -> Column:
        more = F.transform(F.sequence(F.lit(3), F.lit(3) + F.floor(attempt / 4).cast("int")), lambda i: _pick(SYLLABLES[s], seed, i))
        return F.initcap(F.concat(_pick(SYLLABLES[s], seed, 1), _pick(SYLLABLES[s], seed, 2), F.array_join(more, "")))

    of = lambda s: F.when(kind == "surname", surname(s)).otherwise(given(s))
    # Scripts without names of their own here go letter for letter.
    return _let(_script(value), lambda s: F.when(s == "latin", of("latin")).when(s == "cyrillic", of("cyrillic")).when(s == "greek", of("greek")).otherwise(F.concat(like, F.when(attempt >= PATIENCE, F.substring(F.repeat(like, 2), F.lit(1), attempt - PATIENCE + 1)).otherwise(F.lit("")))))


def _address(value: Column, seed: Column, attempt: Column) -> Column:
    """Private blocks stay what they are; after PATIENCE attempts 192.168 widens to 10, then any address, then digits are added."""
    octets = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(seed, i, 254) + 1).cast("string"))
    whole = F.array_join(octets, ".")
    block = F.regexp_extract(value, r"^(10\.|192\.168\.|127\.)", 1)
    tail = lambda n: F.substring_index(whole, ".", -n)
    narrow = F.when(block == "192.168.", F.concat(block, tail(2))).when(block != "", F.concat(block, tail(3))).otherwise(whole)
    wide = F.when(block != "", F.concat(F.lit("10."), tail(3))).otherwise(whole)
    return F.when(attempt < PATIENCE, narrow).when(attempt < 3 * PATIENCE, wide).otherwise(F.concat(whole, F.lit("."), _more(attempt - 2 * PATIENCE, seed, list("123456789"))))


def proposed(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, value, gender, attempt) with cand, the replacement that the attempt proposes."""
    kind, gender, value, attempt = (F.col(c) for c in ("kind", "gender", "value", "attempt"))
    mail = lambda x: F.when(kind == "email", x).otherwise(F.lit(""))
    country = F.when(kind == "phone", F.regexp_extract(value, r"^(\+\d{1,3})(?=[ .(-])", 1)).otherwise(F.lit(""))
    body = F.when(kind == "email", F.substring_index(value, "@", 1)).when(kind == "iban", F.substring(value, F.lit(5), F.length(value))).otherwise(F.substring(value, F.length(country) + 1, F.length(value)))
    # Each step is a projection of its own, so that what several patterns use is computed once.
    df = entities.withColumn("_seed", F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")), 256))
    seed = F.col("_seed")
    df = df.withColumn("_like", _like(body, seed)).withColumn("_host", _like(mail(F.substring_index(F.substring_index(value, "@", -1), ".", 1)), F.concat(seed, F.lit("h"))))
    df = df.withColumn("_digits", _more(attempt, seed, list("0123456789"))).withColumn("_letters", mail(_more(attempt, seed, list(ALPHABETS["latin"]))))
    like, digits = F.col("_like"), F.col("_digits")
    tld = F.substring_index(value, ".", -1)
    email = F.concat(like, F.col("_letters"), F.lit("@"), F.col("_host"), F.lit(".example."), F.when(tld.isin("com", "org", "net"), tld).otherwise(F.lit("org")))
    out = F.when(kind == "email", email).when(kind == "ipv4", _address(value, seed, attempt)).when(kind == "phone", F.concat(country, like, digits)).when(kind == "iban", _iban(value, like, seed, digits))
    out = out.when(kind == "card", _card(value, like, seed, digits)).when(kind == "ssn", F.concat(like, digits)).otherwise(_name(kind, gender, value, like, seed, attempt))
    return df.withColumn("cand", out).drop("_seed", "_like", "_host", "_digits", "_letters")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for distinct entities (kind, value, gender): distinct within a kind, and none an entity itself."""
    names = ["kind", "value", "gender"]
    left = cut(entities.select(*names).withColumn("attempt", F.lit(0)), "entities")
    every = left.select("kind", F.col("value").alias("cand"))
    done: DataFrame | None = None
    while left.take(1):
        tried = cut(proposed(left, key), "tried")
        taken = every if done is None else every.unionByName(done.select("kind", F.col("surrogate").alias("cand")))
        free = tried.join(taken, ["kind", "cand"], "left_anti")
        won = cut(free.groupBy("kind", "cand").agg(F.min("value").alias("value")).select("kind", "value", F.col("cand").alias("surrogate")), "surrogates")
        left = cut(tried.select(*names, (F.col("attempt") + 1).alias("attempt")).join(won, ["kind", "value"], "left_anti"), "left")
        drop(tried)
        done = won if done is None else done.unionByName(won)
    return done if done is not None else left.select("kind", "value", F.lit("").alias("surrogate"))


def replace(docs: DataFrame, key: str = "embertrail") -> DataFrame:
    """doc_id, text with surrogates, n_entities, n_distinct for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Entities are found once and kept beside the texts; texts without any are never shuffled.
    marked = cut(docs.withColumn("_h", F.xxhash64("text")).withColumn("_found", mentions(F.col("text"))), "marked")
    with_any = marked.where(F.size("_found") > 0)
    each = with_any.select("doc_id", "_h", F.explode(F.array_distinct("_found")).alias("_e")).select("doc_id", "_h", F.explode(parts(F.col("_e"))).alias("_p")).select("doc_id", "_h", "_p.*")
    found = cut(each.distinct(), "mentions")
    sure = F.when(F.col("gender") != "u", F.col("gender"))
    entities = found.groupBy("kind", "value").agg(F.min(sure).alias("_lo"), F.max(sure).alias("_hi"))
    gender = F.when(F.col("kind") == "given", _given_gender(F.col("value"), F.col("_lo"), F.col("_hi"))).otherwise(F.lit("u"))
    given = cut(assign(entities.select("kind", "value", gender.alias("gender")), key), "given")
    named = found.select("doc_id", "_h", "kind", "value").distinct().join(given.hint("merge"), ["kind", "value"])
    per = named.groupBy("doc_id", "_h").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "value"), "surrogate"))).alias("_map"))
    per = cut(per.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), "_map"), "maps")
    joined = with_any.join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))

    of = lambda kind, value: F.col("_map")[F.concat_ws(":", kind, value)]

    def new(m: Column) -> Column:
        person = F.array_join(F.transform(parts(m), lambda p: F.coalesce(of(p["kind"], p["value"]), p["value"])), " ")
        return F.when(_kind(m) == "person", F.concat(_title(m), person)).otherwise(person)

    def alone(x: Column) -> Column:
        """Name parts that stand alone between the entities of a text."""
        words, gaps = F.regexp_extract_all(x, F.lit(_WORD), F.lit(1)), F.split(x, _WORD, -1)
        one = lambda w: F.coalesce(of(F.lit("surname"), w), of(F.lit("given"), w), w)
        return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), words.alias("w")), lambda z: F.concat(z["g"], F.when(z["w"].isNotNull(), one(z["w"])).otherwise(F.lit("")))), "")

    has_person = F.exists(F.map_keys("_map"), lambda k: k.startswith("surname:") | k.startswith("given:"))
    segments = F.split("text", FOUND, -1)
    between = lambda x: F.when(has_person, alone(x)).otherwise(x)
    text = F.array_join(F.transform(F.arrays_zip(segments.alias("s"), F.col("_found").alias("m")), lambda z: F.concat(between(F.coalesce(z["s"], F.lit(""))), F.when(z["m"].isNotNull(), new(z["m"])).otherwise(F.lit("")))), "")
    count = lambda a: F.size(a).cast("long")
    changed = joined.select("doc_id", text.alias("text"), count(F.col("_found")).alias("n_entities"), count(F.array_distinct("_found")).alias("n_distinct"))
    same = marked.where(F.size("_found") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_distinct"))
    return changed.unionByName(same)
