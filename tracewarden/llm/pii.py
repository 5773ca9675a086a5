"""Personal data and secrets replaced by keyed surrogates of the same kind and format; DataFrame functions only.

One regular expression finds the entities of a text, in order; splitting the text by the same expression gives what lies
between them, and the two are put together again with a surrogate in place of each entity. A surrogate is a keyed
substitution, character by character: a letter becomes a letter of its own script, case and class (vowel or consonant),
a digit a digit, all else stays; how far a character moves in its class depends on the key and on the characters before it.
Such a substitution can be undone from left to right, so different entities of a kind stay different and the same
entity gets the same surrogate in every document, whichever way it is punctuated. Beyond that, telephone numbers keep
their country and never get an area code that starts with 0 or 1, card numbers and IBANs keep their check digits right (or
wrong), addresses of private networks stay private, and given names become others of the same gender and script.

A name is found by a form of address, a phrase that introduces it, or a listed given name before it; from then on its
single words are replaced wherever they stand alone in the same text, by the same surrogates.

Before any text is replaced, the distinct entities of all documents are checked for two that would get one surrogate;
if there are, the next tweak of the key is taken, until there are none.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Given names by script and gender, and forms of address.
NAMES = {
    "latin_male": "James Robert Michael David Thomas Charles Daniel Matthew Anthony Steven John William Peter Paul George Richard Joseph Edward Henry Hans Klaus Jürgen Wolfgang Stefan Andreas Pierre Jacques François Philippe Carlos José Miguel Antonio Manuel".split(),
    "latin_female": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Laura Julia Helen Margaret Emily Charlotte Ursula Ingrid Sabine Monika Marie Sylvie Françoise Sophie María Carmen Lucía Isabel".split(),
    "cyrillic_male": "Иван Сергей Дмитрий Алексей Николай Владимир Андрей Михаил".split(),
    "cyrillic_female": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    "greek_male": "Γιώργος Κώστας Δημήτρης Νίκος Παναγιώτης".split(),
    "greek_female": "Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
}
#: Words after which a name follows, or that come before it, as forms of address do.
TITLES = r"(?:[Mm]y name is|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Мм]еня зовут|[Nn]ame:|Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|Mlle|г-н|г-жа|господин|госпожа|κύριος|κυρία)\.?"
# Words that start sentences and are no names, and lengths of country codes.
NO_NAMES = "The This That And But For You She His Her They Der Die Das Und Ein Eine Les Des Une Est Los Las Una Que".split()
COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# Letters by script, case and class.
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåéèêëíìîïóòôöõúùûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")

_GIVEN = "|".join(n for names in NAMES.values() for n in names)
_WORD = r"\p{Lu}[\p{L}’'\-]++"
PATTERNS = {
    "email": r"(?<![._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{2,}+",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "card": r"\d{4}(?:[ \-]?\d{4}){3}(?!\d)|\d{4}[ \-]?\d{6}[ \-]?\d{5}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?:\+(?:[17]|\d{2,3})[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|\d{3}([ .\-])\d{3}\1\d{4}(?!\d)|\+\d{1,3}(?:[ .\-]?\d{1,4}){3,6}(?!\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})(?![0-9A-Za-z])",
    "password": r"(?i:(?:password|passwd|pwd|secret|api_?key|token)[\"']?(?: ?= ?[\"']?| ?: ?[\"']?(?=[^\s\"',;]*\d))|(?:password|passwd|pwd|api_?key)[\"']? ?: ?[\"']?(?=[^\s\"',;]{10}|(?-i:[^\s\"',;]*[a-z][A-Z])[^\s\"',;]*|[^\s\"',;]*[!#$%&*@^]))[^\s\"',;]{3,}[^\s\"',;.!?)\]]",
    "name": rf"(?=\p{{Lu}}|[гκmnjм])(?:{TITLES} {_WORD}(?: {_WORD})?|(?:{_GIVEN}) {_WORD})",
}
#: A telephone number may start with a parenthesis or a plus; nothing starts inside a word.
ENTITY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(PATTERNS.values()) + ")"
_DIGITS = "0123456789"


def _prf(key: str, kind: str, tweak: int, seen: Column) -> Column:
    """A keyed number from 0 to 2^48 - 1 of what came before."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{kind}|{tweak}|"), seen).cast("binary"), 256), 1, 12), 16, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once and named, so that the expression doesn't grow with its uses."""
    return F.get(F.transform(F.array(value), use), 0)


def _moved(x: Column, alphabet: Column, shift: Column, first: Column) -> Column:
    """``x`` moved within the alphabet; the first character of an entity is always moved to another."""
    n = F.length(alphabet)
    by = F.when(first & (n > 1), 1 + F.pmod(shift, F.greatest(n - 1, F.lit(1)))).otherwise(F.pmod(shift, n))
    return F.substring(alphabet, (F.pmod(F.instr(alphabet, x) - 1 + by, n) + 1).cast("int"), F.lit(1))


def _cipher(e: Column, prf: Callable[[Column], Column], alphabet: Callable[[Column, Column], Column], skip: int = 0) -> Column:
    """Substitute the characters of ``e`` for which ``alphabet`` (character, number of those before it) has one; the first ``skip`` of them stay."""

    def step(acc: Column, x: Column, a: Column) -> Column:
        n = F.length(acc["seen"])
        new = F.when(n < skip, x).otherwise(_let(prf(acc["seen"]), lambda shift: _moved(x, a, shift, n == skip)))
        return F.struct(F.concat(acc["out"], F.when(a.isNull(), x).otherwise(new)).alias("out"), F.concat(acc["seen"], F.when(a.isNull(), "").otherwise(F.lower(x))).alias("seen"))

    def at(acc: Column, x: Column) -> Column:
        return F.when(x == "", acc).otherwise(_let(alphabet(x, F.length(acc["seen"])), lambda a: step(acc, x, a)))

    return F.aggregate(F.split(e, ""), F.struct(F.lit("").alias("out"), F.lit("").alias("seen")), at, lambda acc: acc["out"])


def _one_of(*alphabets: str) -> Callable[[Column, Column], Column]:
    """The alphabet that has the character."""
    return lambda x, n: F.get(F.filter(F.array(*map(F.lit, alphabets)), lambda a: F.instr(a, x) > 0), 0)


_alnum = _one_of(_DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_letters = _one_of(*CLASSES, *(c.replace("ß", "").upper() for c in CLASSES))
_hex = _one_of(_DIGITS, "abcdef")
_number = _one_of(_DIGITS)


def _dialled(x: Column, n: Column) -> Column:
    return F.when((n == 0) | (n == 3), _one_of("23456789", "01")(x, n)).otherwise(_number(x, n))


def _luhn(digits: Column) -> Column:
    """Check digit of the digits."""

    def step(acc: Column, x: Column) -> Column:
        d = F.ascii(x) - 48
        new = acc["sum"] + F.when(acc["odd"], 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return F.when(x == "", acc).otherwise(F.struct(new.alias("sum"), (~acc["odd"]).alias("odd")))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), step, lambda acc: (10 - acc["sum"] % 10) % 10)


def _mod97(text: Column) -> Column:
    def step(acc: Column, x: Column) -> Column:
        return F.when(x.between("0", "9"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(step(acc, x)))


def _last(e: Column) -> Column:
    return F.substring(e, F.length(e), F.lit(1))


def _but_last(e: Column) -> Column:
    return F.substring(e, F.lit(1), F.length(e) - 1)


def _surrogates(key: str, tweak: int) -> dict[str, Callable[[Column], Column]]:
    def prf(kind: str) -> Callable[[Column], Column]:
        return lambda seen: _prf(key, kind, tweak, seen)

    def email(e: Column) -> Column:
        def domain(d: Column) -> Column:
            tail = F.regexp_extract(d, r"(?:\.(?:co|com|org|ac|gov|net|edu))?\.[A-Za-z]+$", 0)
            other = _let(tail, lambda t: F.concat(_cipher(F.substring(d, F.lit(1), F.length(d) - F.length(t)), prf("domain"), _alnum), t))
            return F.when(F.lower(d).rlike(r"(^|\.)example\.(com|org|net)$"), d).otherwise(other)

        return F.concat(_cipher(F.substring_index(e, "@", 1), prf("email"), _alnum), F.lit("@"), _let(F.substring_index(e, "@", -1), domain))

    def ip(e: Column) -> Column:
        def moved(part: Column) -> Column:
            o, f = [F.get(part, k) for k in range(4)], prf("ip")
            public = [n for n in range(1, 224) if n not in (10, 127, 169, 172, 192)]
            listed = F.array(*map(F.lit, public))
            at = F.array_position(listed, o[0])
            first = F.when(at > 0, F.get(listed, F.pmod(at + F.pmod(f(F.lit("")), F.lit(len(public) - 1)), F.lit(len(public))).cast("int"))).otherwise(o[0])
            second = F.when(o[0].isin(169, 172, 192), o[1]).otherwise(F.pmod(o[1] + f(o[0].cast("string")), F.lit(256)))
            third = F.pmod(o[2] + f(F.concat_ws(".", F.slice(part, 1, 2).cast("array<string>"))), F.lit(256))
            fourth = F.pmod(o[3] + 1 + F.pmod(f(F.concat_ws(".", F.slice(part, 1, 3).cast("array<string>"))), F.lit(255)), F.lit(256))
            return F.concat_ws(".", *[x.cast("string") for x in (first, second, third, fourth)])

        return _let(F.split(e, r"\.").cast("array<int>"), moved)

    def card(e: Column) -> Column:
        digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
        check = lambda new: F.pmod(_luhn(digits(new)) + F.ascii(_last(e)) - 48 - _luhn(digits(_but_last(e))), F.lit(10))
        return _let(_cipher(_but_last(e), prf("card"), _number, skip=1), lambda new: F.concat(new, check(new).cast("string")))

    def phone(e: Column) -> Column:
        country = F.regexp_extract(e, rf"^{COUNTRY}[ .\-]?", 0)
        return _let(country, lambda c: F.concat(c, _cipher(F.substring(e, F.length(c) + 1, F.length(e)), prf("phone"), _dialled)))

    def iban(e: Column) -> Column:
        country, check, body = F.substring(e, 1, 2), F.substring(e, 3, 2).cast("int"), F.substring(e, F.lit(5), F.length(e))
        right = lambda b: 98 - _mod97(F.concat(F.regexp_replace(b, " ", ""), country, F.lit("00")))
        moved = lambda new: F.when(check.between(2, 98), F.pmod(right(new) - 2 + check - right(body), F.lit(97)) + 2).otherwise(check)
        return _let(_cipher(body, prf("iban"), _alnum), lambda new: F.concat(country, F.lpad(moved(new).cast("string"), 2, "0"), new))

    def secret(e: Column) -> Column:
        """The same for a value by itself and after its name: what is hexadecimal stays so, a tagged key keeps its tag."""
        tagged = F.concat(F.substring(e, 1, 4), _cipher(F.substring(e, F.lit(5), F.length(e)), prf("key"), _alnum))
        return F.when(e.rlike("^(?:AKIA|ASIA)"), tagged).when(e.rlike("^[0-9a-f]+$"), _cipher(e, prf("key"), _hex)).otherwise(_cipher(e, prf("key"), _alnum))

    def password(e: Column) -> Column:
        head = F.regexp_extract(e, r"^[A-Za-z_]+[\"']? ?[=:] ?[\"']?", 0)
        return _let(head, lambda h: F.concat(h, _let(F.substring(e, F.length(h) + 1, F.length(e)), secret)))

    def word(w: Column) -> Column:
        """A listed given name moves in its list; any other word keeps its last letter, as endings show gender, and never becomes a listed name."""
        f, names = prf("name"), [n for ns in NAMES.values() for n in ns]
        walk = lambda x: F.concat(_cipher(_but_last(x), f, _letters), _last(x))
        other = _let(walk(w), lambda once: F.when(once.isin(names), walk(once)).otherwise(once))
        lists = F.array(*[F.array(*map(F.lit, ns)) for ns in NAMES.values()])
        step = lambda mine: F.pmod(F.array_position(mine, w) + F.pmod(f(F.lit("")), F.size(mine) - 1), F.size(mine))
        return _let(F.get(F.filter(lists, lambda ns: F.array_contains(ns, w)), 0), lambda mine: F.when(mine.isNull(), other).otherwise(F.get(mine, step(mine).cast("int"))))

    def name(e: Column) -> Column:
        title = F.regexp_extract(e, rf"^(?:{TITLES} )?", 0)
        return _let(title, lambda t: F.concat(t, F.array_join(F.transform(F.split(F.substring(e, F.length(t) + 1, F.length(e)), " "), word), " ")))

    return {"email": email, "ip": ip, "card": card, "ssn": lambda e: _cipher(e, prf("ssn"), _number), "phone": phone, "iban": iban, "key": secret, "password": password, "name": name}


def kind_of(e: Column) -> Column:
    """The first kind whose pattern matches the whole entity."""
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(e.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def surrogate(e: Column, kind: Column, key: str, tweak: int = 0) -> Column:
    """The surrogate of an entity of this kind."""
    out = e
    for name, make in _surrogates(key, tweak).items():
        out = F.when(kind == name, make(e)).otherwise(out)
    return out


def same(e: Column, kind: Column) -> Column:
    """What an entity is, however written: digits of numbers, an address in lower case, a name without title."""
    return (
        F.when(kind.isin("card", "ssn"), F.regexp_replace(e, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(e, rf"^{COUNTRY}[ .\-]?", ""), "[^0-9]", ""))
        .when(kind == "email", F.lower(e))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "name", F.regexp_replace(e, rf"^{TITLES} ", ""))
        .when(kind == "password", F.regexp_replace(e, r"^[A-Za-z_]+[\"']? ?[=:] ?[\"']?", ""))
        .otherwise(e)
    )


def entities(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def clashes(docs: DataFrame, key: str, tweak: int, text_col: str = "text") -> DataFrame:
    """(kind, surrogate) that two different entities of ``docs`` would share."""
    found = docs.select(F.explode(entities(F.col(text_col))).alias("e")).distinct()
    named = found.select("e", kind_of(F.col("e")).alias("kind"))
    each = named.select(F.when(F.col("kind") == "password", "key").otherwise(F.col("kind")).alias("group"), "kind", same(F.col("e"), F.col("kind")).alias("entity"), surrogate(F.col("e"), F.col("kind"), key, tweak).alias("s"))
    shared = each.groupBy(F.col("group").alias("kind"), same(F.col("s"), F.col("kind")).alias("surrogate")).agg(F.min("entity").alias("a"), F.max("entity").alias("b"))
    return shared.where("a != b").select("kind", "surrogate")


def distinct_tweak(docs: DataFrame, key: str, text_col: str = "text", tries: int = 8) -> int:
    """The first tweak of the key under which no two entities of ``docs`` share a surrogate.

    If none of ``tries`` is such, that with the fewest shared surrogates, and a warning that says how many there are.
    """
    fewest = None
    for tweak in range(tries):
        n = clashes(docs, key, tweak, text_col).count()
        if fewest is None or n < fewest[0]:
            fewest = n, tweak
        if n == 0:
            return tweak
    warnings.warn(f"{fewest[0]} surrogates stand for more than one entity", stacklevel=2)
    return fewest[1]


def _mentions(found: Column) -> Column:
    """A pattern for entities that also has the single words of a text's names, wherever they stand alone in it."""
    names = F.filter(found, lambda e: e.rlike(f"^(?:{PATTERNS['name']})$"))
    each = F.flatten(F.transform(names, lambda e: F.split(F.regexp_replace(e, rf"^{TITLES} ", ""), " ")))
    words = F.array_distinct(F.filter(each, lambda w: (F.length(w) > 2) & ~w.isin(NO_NAMES)))
    return F.when(F.size(words) > 0, F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}_])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}_])")))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", tweak: int | None = None, entities_col: str = "entities") -> DataFrame:
    """``docs`` with surrogates in its texts, and ``entities_col``: array of (kind, surrogate), in order of appearance.

    A null text stays null and has no entities, an empty one is unchanged; so is a text without entities. Texts are read
    whole. Repeated rows and all other columns are kept (a column named ``entities_col`` is replaced).
    ``tweak``: None looks for the first one without collisions over all rows of ``docs``.
    """
    tweak = distinct_tweak(docs, key, text_col) if tweak is None else tweak
    text, pattern = F.col(text_col), F.col("__mentions")
    found = docs.withColumn(entities_col, F.coalesce(entities(text), F.array().cast("array<string>")))
    found = found.withColumn("__mentions", F.when(F.size(entities_col) > 0, _mentions(F.col(entities_col))))
    found = found.withColumn(entities_col, F.when(pattern.isNotNull(), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.col(entities_col)))
    named = found.withColumn(entities_col, F.transform(entities_col, lambda e: _let(kind_of(e), lambda kind: F.struct(kind.alias("kind"), surrogate(e, kind, key, tweak).alias("surrogate")))))
    between = F.split(text, F.coalesce(pattern, F.lit(ENTITY)), -1)
    joined = F.array_join(F.zip_with(between, entities_col, lambda a, e: F.concat(a, F.coalesce(e["surrogate"], F.lit("")))), "")
    return named.withColumn(text_col, F.when(F.size(entities_col) > 0, joined).otherwise(text)).drop("__mentions")
