"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

Entities (e-mail, IBAN, IPv6, card, social security number, phone, IPv4, secret,
name) are found with one pattern.  Each distinct normalised entity gets a
surrogate from a keyed SHA-256 stream: same kind, same script, digits for digits,
letters for letters, valid check digits, the title's gender for given names.  Two
entities of one kind never share a surrogate, and no surrogate equals a real
entity of the corpus: the distinct entities are grouped by surrogate, the losers
of a group draw again from ever wider forms, until no group has two.  Equal
entities get equal surrogates in every document, however their separators are
written.

Names go by the word.  A title, with initials and up to three capitalised words
behind it, makes the last word a family name and the others given names; from
then on these words are names wherever they stand in that document, with a title
or without, and so are initials before them.  A word has one surrogate in all
documents (a given name one for each gender its titles tell, and none of its own
for a title without gender, if the corpus tells one gender), so "Mrs Jane Roe",
"Jane Roe", "Dr. Roe" and "Roe" stay one person.  Initials are shifted by the
key.  Names that no title ever introduces in a document are not found, and a
name that is a ``COMMON`` word too (Brown, May) only beside a title, an initial
or another word of the name.  A given name's gender shows in its ending.

A secret is what follows ``password``, ``passwd``, ``pwd``, ``secret``, ``token``,
``api_key`` or ``apikey``, quoted or not, and ``=`` or ``:``, of any length: in quotes all up to
the closing quote of the line, else all up to white space or a quote that ends
a word, less the punctuation at its end.  Letters and digits are replaced and
signs stay, unless it has only signs.  Without quotes, one sign repeated
(a blank to fill in) or signs that end a sentence are no secret.  Access key ids
and what follows ``Bearer`` are secrets too.

Telephone numbers are those of three, three and four digits, international ones
and the national forms of Germany and France; the last nine digits tell whether
a national and an international spelling are one number.

The texts are scanned once and written with what was found; texts without an
entity pass through, only texts with one are shuffled, and the entity join is a
plain equi-join that Spark may split where one entity is very frequent.

Defined results: null and empty texts stay as they are with 0 entities;
repeated rows are rewritten alike; null ids are kept; an empty table gives an
empty one; of the input only the named columns are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# Entity patterns, in order of precedence.
KEY = r"\b(?:password|passwd|pwd|secret|token|api_key|apikey)[\"']?\s{0,2}[=:]\s{0,2}"
#: Of a value without quotes: what it is made of, and what only belongs to it if more follows.
CORE, TAIL = r"[^\s\"'.,;:!?)\]}>]", r"[.,;:!?)\]}>]"
#: A letter or digit, or else two unlike signs: a rule of dashes or a blank is no value.
VALUE = rf"(?![\"'])(?=\S*[\p{{L}}\p{{N}}]|(?<sign>\S)\k<sign>*+\S)(?:{CORE}++|{TAIL}++(?=[\"']*+{CORE})|[\"']++(?={CORE}))++"
#: To the closing quote of its line, else to white space or a quote at a word's end; the first look keeps the longer ones few.
SECRET = (
    rf"(?<=[=:\"'\s])(?:(?<=(?i:{KEY})\")(?!\s)(?:[^\"\\\r\n]++|\\.)++(?=\")|(?<=(?i:{KEY})')(?!\s)(?:[^'\\\r\n]++|\\.)++(?=')"
    rf"|(?<=(?i:{KEY})[\"']?){VALUE})"
    r"|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16,}+|(?<=\b[Bb]earer )(?=[A-Za-z._~+/\-]*+\d)[A-Za-z0-9._~+/\-]{20,}+=*+"
)
#: From the start of its run of characters, so that a long run is read once; a host has at most 127 labels.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.){1,126}[A-Za-z]{2,63}"
IBAN = r"(?<![A-Za-z0-9])(?=(?:[A-Z]{0,6}+ ?\d){8})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,7}}:(?:{HEX}(?::{HEX}){{0,5}})?|::{HEX}(?::{HEX}){{0,5}})(?![0-9A-Za-z:])"
CARD = r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?![\d])"
SSN = r"(?<![\d\-.])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"
#: International, German and French numbers of eight to fifteen digits.
TEL = (
    r"(?<![\w.+])(?:(?=\+(?:[ .\-/()]{0,2}\d){8,15}(?!\d))\+\d{1,3}(?:[ .\-/]?\(?\d{1,12}\)?){1,6}"
    r"|0[1-9](?<sep>[ .\-])\d{2}(?:\k<sep>\d{2}){3}|\(?0[1-9]\d{1,3}\)?[ /\-]\d{5,8})(?![\d])"
)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Dame|Lady|г-жа"
MALE = r"Mr|Herr|Monsieur|Señor|Sir|Lord|г-н"
NEUTRAL = r"Dr|Prof"
TITLE = rf"(?:{FEMALE}|{MALE}|{NEUTRAL})\.? (?:(?:{NEUTRAL})\.? )?"
WORD = r"\p{Lu}[\p{L}\p{M}'\-]++"
#: What may stand before a word of a name: initials and small words.
BEFORE = r"(?:\p{Lu}\. ?)*+(?:(?:von|van|de|der|den|del|di|da|du|la|le|zu) )*+"
NAME = rf"(?<![\p{{L}}]){TITLE}{BEFORE}{WORD}(?: {BEFORE}{WORD}){{0,2}}"
#: All kinds but names.
PLAIN = "|".join((SECRET, EMAIL, IBAN, IP6, CARD, SSN, PHONE, TEL, IP))
#: What any entity must contain; a cheap first look.
HINT = rf"[0-9@=:]|{FEMALE}|{MALE}|{NEUTRAL}"

#: Names that are common words as well, written with a capital in the languages served.
COMMON = (
    "april", "august", "best", "bishop", "black", "blue", "brown", "day", "friday", "good", "gray", "green", "grey", "june", "king", "little", "long", "march", "may", "monday", "pope", "prince", "rich", "rose", "sharp", "short", "small", "strong", "summer", "sunday", "white", "winter", "wise", "young",
    "abend", "braun", "freitag", "grau", "grün", "herbst", "juli", "juni", "kaiser", "kurz", "könig", "lang", "mai", "montag", "morgen", "märz", "schwarz", "sommer", "sonntag", "weiß",
    "août", "avril", "blanc", "bon", "dimanche", "grand", "juin", "lundi", "mars", "noir", "petit", "roi", "vendredi",
    "abril", "agosto", "blanco", "bueno", "domingo", "lunes", "mayo", "negro", "rey", "viernes",
)
#: One or more initials from the first of their run, so that a long run is read once.
INITIALS = r"(?<!\p{Lu}\.)(?<!\p{Lu}\. )(?:\p{Lu}\. ?)++"

CONSONANTS, VOWELS = "bdfgklmnprstvz", "aeio"
LATIN, CYRILLIC, GREEK = "abdefgiklmnoprstvz", "абдефгиклмнопрствз", "αβδεφγικλμνοπρστχζ"
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")


def kind_of(raw: Column) -> Column:
    """The kind of what is no name, from its own form; a secret is what has no other."""
    only = lambda p: raw.rlike(f"^(?:{p})$")
    return (
        F.when(only(EMAIL), "email")
        .when(only(IBAN), "iban")
        .when(only(IP6), "ip6")
        .when(only(r"\d(?:[ \-]?\d){12,18}") & ~only(r"\d{3}[ \-]\d{3}[ \-]\d{4}"), "card")
        .when(only(SSN), "ssn")
        .when(only(rf"(?:{OCTET}\.){{3}}{OCTET}"), "ip")
        .when(only(PHONE), "phone")
        .when(only(TEL), "tel")
        .otherwise("secret")
    )


def named(found: Column) -> Column:
    """The words of the titled names among the entities: ``kind``, ``word`` in small letters, ``own`` spelling; family names first."""

    def words(name: Column) -> Column:
        title = F.substring_index(F.regexp_replace(name, r"\.", " "), " ", 1)
        gender = F.when(title.rlike(f"^(?:{FEMALE})$"), "given_f").when(title.rlike(f"^(?:{MALE})$"), "given_m").otherwise("given_n")
        own = F.regexp_extract_all(F.regexp_replace(name, rf"^{TITLE}", ""), F.lit(rf"(?<![\p{{L}}\p{{M}}'\-]){WORD}"), F.lit(0))
        return F.transform(own, lambda w, i: F.struct(F.when(i == F.size(own) - 1, "family").otherwise(gender).alias("kind"), F.lower(w).alias("word"), w.alias("own")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(found, lambda x: x.rlike(rf"^{TITLE}")), words))))


def pattern_of(known: Column) -> Column:
    """The pattern of a text's entities, its known names word by word, also in capitals, and the initials before them.

    Common words must stand behind a title, an initial or a word of the name, or before one.
    """
    common = F.array(*map(F.lit, COMMON))
    spelled = lambda some: F.array_join(F.array_distinct(F.flatten(F.transform(some, lambda x: F.array(x["own"], F.upper(x["own"]), F.initcap(x["word"]))))), "|")
    every, plain = spelled(known), F.filter(known, lambda x: ~F.array_contains(common, x["word"]))
    usual = F.filter(known, lambda x: F.array_contains(common, x["word"]))
    end = r"(?![\p{L}\p{M}])"
    lit = F.lit
    own = F.when(F.size(plain) > 0, F.concat(lit("(?:"), spelled(plain), lit(f"){end}|"))).otherwise("")
    beside = F.concat(lit(rf"(?<=(?<![\p{{L}}])(?:{TITLE}|\p{{Lu}}\. ?|(?:"), every, lit(") ))(?:"), spelled(usual), lit(rf"){end}|(?:"), spelled(usual), lit(rf")(?= {BEFORE}(?:"), every, lit(rf"){end})|"))
    initials = F.concat(lit(rf"{INITIALS}(?=(?:"), every, lit(rf"){end})"))
    return F.when(F.size(known) > 0, F.concat(lit(PLAIN + r"|(?<![\p{L}\p{M}])(?:"), own, F.when(F.size(usual) > 0, beside).otherwise(""), initials, lit(")"))).otherwise(PLAIN)


def digits_of(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def normal_of(kind: Column, raw: Column) -> Column:
    """What makes two spellings one entity."""
    return (
        F.when(kind.isin("email", "ip6") | kind.startswith("given") | (kind == "family"), F.lower(raw))
        .when(kind.isin("card", "ssn"), digits_of(raw))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "phone", F.right(digits_of(raw), F.lit(10)))
        .when(kind == "tel", F.right(digits_of(raw), F.lit(9)))
        .otherwise(raw)
    )


def _number(digest: Column, at: int, size: int) -> Column:
    """``size`` hex digits of the digest from place ``at`` as a number."""
    return F.conv(F.substring(digest, at + 1, size), 16, 10).cast("long")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not once per character."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _drawn(digest: Column, i: Column, alphabet: Column) -> Column:
    """The character at place ``i`` (from 1) of the stream: one per pair of hex digits, round and round."""
    pair = F.conv(F.substr(digest, F.pmod((i - 1) * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
    return F.substr(alphabet, F.pmod(pair + i, F.length(alphabet)) + 1, F.lit(1))


def _stream(digest: Column, length: Column, alphabet: Column) -> Column:
    """``length`` characters of the alphabet."""
    return F.when(length > 0, _bound(digest, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: _drawn(d, i, alphabet)), ""))).otherwise("")


def _like(raw: Column, digest: Column, digits: str = "0123456789", lower: str = "abcdefghijklmnopqrstuvwxyz", cyrillic: str = "абвгдежзиклмнопрстуфхцчшэюя") -> Column:
    """Each digit, lower and upper letter replaced by one of its class; everything else stays."""

    def one(d: Column, c: Column, at: Column) -> Column:
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), _drawn(d, at + 1, F.lit(cyrillic))).otherwise(_drawn(d, at + 1, F.lit(lower)))
        return F.when(c.rlike(r"\p{N}"), _drawn(d, at + 1, F.lit(digits))).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"[\p{L}\p{M}]"), letter).otherwise(c)

    return F.when(F.length(raw) > 0, _bound(digest, lambda d: F.array_join(F.transform(F.split(raw, ""), lambda c, at: one(d, c, at)), ""))).otherwise("")


def _luhn(body: Column) -> Column:
    """The check digit that completes the card number."""
    n = F.length(body)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when(F.pmod(n - i, F.lit(2)) == 0, F.substr(body, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(body, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)).otherwise(F.substr(body, i, F.lit(1)).cast("int")),
    )
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    """The number that the text is with A = 10 to Z = 35, modulo 97."""
    digit = lambda c: c.rlike("[0-9]")
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(digit(c), F.pmod(acc * 10 + c.try_cast("int"), F.lit(97))).when(c == "", acc).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))))


#: Draws from which a form without room to spare is made longer.
LAST_FORM = 12


def surrogate_of(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The normalised surrogate.  From the fourth draw on, the forms have more room, and in the end as much as it takes."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, normal, attempt.cast("string")), 256)
    wide = attempt >= 4
    local = F.substring_index(normal, "@", 1)
    number = lambda at, n, size: F.lpad(F.pmod(_number(digest, at, 8), F.lit(n)).cast("string"), size, "0")
    email = F.concat(_like(local, digest), F.when(wide, _stream(F.reverse(digest), attempt, F.lit("0123456789"))).otherwise(""), F.lit("@mail"), F.pmod(_number(digest, 60, 4), F.lit(10)).cast("string"), F.lit(".example.org"))
    ip = F.concat_ws(".", F.when(wide, (F.lit(11) + F.pmod(_number(digest, 0, 4), F.lit(110))).cast("string")).otherwise("10"), *[F.pmod(_number(digest, k, 4), F.lit(256)).cast("string") for k in (4, 8, 12)])
    ip6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substring(digest, k, 4) for k in range(1, 25, 4)])
    body = F.concat(F.substring(normal, 1, 1), _stream(digest, F.length(normal) - 2, F.lit("0123456789")))
    ssn = F.concat(F.lit("9"), number(0, 100, 2), number(8, 100, 2), number(16, 10000, 4))
    account, country = _like(F.substr(normal, F.lit(5)), digest), F.substring(normal, 1, 2)
    iban = F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(F.upper(account), country, F.lit("00")))).cast("string"), 2, "0"), F.upper(account))
    area = F.concat((F.lit(2) + F.pmod(_number(digest, 0, 4), F.lit(8))).cast("string"), F.lpad(F.pmod(_number(digest, 4, 4), F.lit(100)).cast("string"), 2, "0"))
    exchange = F.when(wide, F.concat((F.lit(2) + F.pmod(_number(digest, 20, 4), F.lit(8))).cast("string"), F.lpad(F.pmod(_number(digest, 24, 4), F.lit(100)).cast("string"), 2, "0"))).otherwise("555")
    phone = F.concat(area, exchange, number(8, 10000, 4))
    tel = F.concat(F.substring(normal, 1, 1), _stream(digest, F.length(normal) - 1, F.lit("0123456789")))
    hexed = normal.rlike("^[0-9a-f]+$")
    lettered = normal.rlike(r"[\p{L}\p{N}]")
    secret = F.when(hexed, _stream(digest, F.length(normal), F.lit("0123456789abcdef"))).when(lettered, _like(normal, digest)).otherwise(_stream(digest, F.length(normal), F.lit("abcdefghijklmnopqrstuvwxyz")))
    secret = F.concat(secret, F.when(wide, _stream(F.reverse(digest), attempt, F.lit("0123456789"))).otherwise(""))
    fixed = F.when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", F.concat(body, _luhn(body))).when(kind == "phone", phone).when(kind == "tel", tel).when(kind == "ssn", ssn).when(kind == "iban", iban)
    longer = F.when(attempt >= LAST_FORM, F.concat(F.when(kind.isin("ip", "ip6"), ":").otherwise(""), _stream(F.reverse(digest), attempt - LAST_FORM + 1, F.lit("0123456789")))).otherwise("")
    return F.when(kind == "email", email).when((kind == "family") | kind.startswith("given"), _name_word(kind, normal, digest, attempt)).when(kind == "secret", secret).otherwise(F.concat(fixed, longer))


def _name_word(kind: Column, normal: Column, digest: Column, attempt: Column) -> Column:
    """A name of syllables in small letters, ending as its kind asks, in its script."""
    pick = lambda letters, at: F.substr(F.lit(letters), F.pmod(_number(digest, at, 4), F.lit(len(letters))).cast("int") + 1, F.lit(1))
    syllables = [x for k in (0, 8, 16) for x in (pick(CONSONANTS, k), pick(VOWELS, k + 4))]
    ending = F.when(kind == "family", "n").when(kind == "given_f", "la").when(kind == "given_m", "ton").otherwise("ri")
    latin = F.concat(*syllables, F.when(attempt >= 4, _stream(digest, attempt, F.lit(VOWELS))).otherwise(""), ending)
    return F.when(normal.rlike(r"\p{IsCyrillic}"), F.translate(latin, LATIN, CYRILLIC)).when(normal.rlike(r"\p{IsGreek}"), F.translate(latin, LATIN, GREEK)).otherwise(latin)


def initial_of(raw: Column, key: str) -> Column:
    """The letters, shifted within their alphabet by a step that the key gives: distinct letters stay distinct."""
    number = int(hashlib.sha256(f"{key}|initial".encode()).hexdigest()[:6], 16)
    turned = [letters[step:] + letters[:step] for letters in ALPHABETS for step in [number % (len(letters) - 1) + 1]]
    return F.translate(raw, "".join(ALPHABETS).upper(), "".join(turned).upper())


def shaped(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of this occurrence: its separators, country code and capitals."""

    def filled(taken: str) -> Column:
        """Each character of the class replaced in order, from the right if the surrogate is shorter; what is over follows."""
        own = lambda c: F.length(F.regexp_replace(c, f"[^{taken}]", ""))
        skip = F.greatest(own(raw) - F.length(surrogate), F.lit(0))
        before = lambda i: own(F.substr(raw, F.lit(1), i))
        one = lambda i: F.substr(raw, i, F.lit(1))
        put = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(one(i).rlike(f"[{taken}]") & (before(i) > skip), F.substr(surrogate, before(i) - skip, F.lit(1))).otherwise(one(i)))
        return F.concat(F.array_join(put, ""), F.substr(surrogate, own(raw) - skip + 1))

    capital = raw == F.upper(raw)
    name = F.when(capital & (F.length(raw) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return (
        F.when(kind.isin("card", "phone", "tel", "ssn"), filled("0-9"))
        .when(kind == "iban", filled("A-Z0-9"))
        .when((kind == "family") | kind.startswith("given"), name)
        .when(kind.isin("email", "ip6") & capital & raw.rlike("[A-Z]"), F.upper(surrogate))
        .otherwise(surrogate)
    )


def scanned(rows: DataFrame, text: str) -> DataFrame:
    """The rows with ``__items``, the entities of the text in order, and ``__known``, its name words."""
    hinted = F.col(text).rlike(HINT)
    first = rows.withColumn("__found", F.when(hinted, F.regexp_extract_all(F.col(text), F.lit(f"{PLAIN}|{NAME}"), F.lit(0))))
    first = first.withColumn("__known", F.when(F.exists("__found", lambda x: x.rlike(rf"^{TITLE}")), named(F.col("__found"))))
    again = F.regexp_extract_all(F.col(text), pattern_of(F.col("__known")), F.lit(0))
    return first.withColumn("__items", F.when(F.size("__known") > 0, again).otherwise(F.col("__found"))).drop("__found")


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """``kind, normal, surrogate`` of the distinct entities, without collisions.

    Each round is one shuffle of the distinct entities by surrogate.  The real
    entities take part as holders of their own forms, so that no surrogate is
    one of them; of several with one surrogate the earliest draw keeps it.  Forms
    grow with the draws, so the rounds end.
    """
    drawn = found.select("kind", "normal").distinct().withColumn("attempt", F.lit(0))
    drawn = C.stored(drawn.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("normal"), F.col("attempt"), key)), "surrogates")
    while True:
        real = drawn.select("kind", "normal", F.lit(-1).alias("attempt"), F.col("normal").alias("surrogate"))
        holder = drawn.unionByName(real).groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "normal")).alias("holder"), F.count("*").alias("n")).where("n > 1")
        if not holder.limit(1).count():
            return drawn.select("kind", "normal", "surrogate")
        lost = drawn.join(holder, ["kind", "surrogate"], "left").withColumn("lost", F.col("holder").isNotNull() & (F.struct("attempt", "normal") != F.col("holder")))
        again = F.when(F.col("lost"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        drawn = C.stored(lost.select("kind", "normal", again.alias("attempt"), "lost", "surrogate").withColumn("surrogate", F.when(F.col("lost"), surrogate_of(F.col("kind"), F.col("normal"), F.col("attempt"), key)).otherwise(F.col("surrogate"))).drop("lost"), "surrogates")


def occurrences(marked: DataFrame) -> DataFrame:
    """``__key, __at, raw, kind, normal``: every entity of every distinct text."""
    each = marked.select("__key", "__known", F.posexplode("__items").alias("__at", "raw"))
    known = F.filter("__known", lambda x: x["word"] == F.lower("raw"))
    each = each.select("__key", "__at", "raw", F.when(F.size(known) > 0, known[0]["kind"]).when(F.col("raw").rlike(r"^(?:\p{Lu}\. ?)++$") & (F.size("__known") > 0), "initial").otherwise(kind_of(F.col("raw"))).alias("kind")).distinct()
    each = C.stored(each.withColumn("normal", normal_of(F.col("kind"), F.col("raw"))), "entities")
    # a title without gender takes the one that the corpus tells of the name
    told = each.where("kind in ('given_f', 'given_m')").groupBy("normal").agg(F.min("kind").alias("told"), F.max("kind").alias("other")).where("told = other")
    return each.join(told.select("normal", F.lit("given_n").alias("kind"), "told"), ["kind", "normal"], "left").withColumn("kind", F.coalesce("told", "kind")).drop("told")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """The same rows and columns with the text rewritten.

    ``count`` names a column for the number of entities; a name counts by its family name.
    """
    counted = [F.lit(0).alias(count)] if count else []
    columns = [F.col(c) for c in docs.columns if c != count]
    rows = C.stored(scanned(docs.select(*columns), text), "scanned")
    plain = rows.where("coalesce(size(__items), 0) <= 0").select(*columns, *counted)
    # equal texts are rewritten alike, so the text's digest stands for the row
    marked = rows.where("size(__items) > 0").withColumn("__key", F.sha2(F.col(text), 256))
    occurs = occurrences(marked)
    known = surrogates(occurs.where("kind <> 'initial'"), key)
    new = F.when(F.col("kind") == "initial", initial_of(F.col("raw"), key)).otherwise(shaped(F.col("kind"), F.col("raw"), F.col("surrogate")))
    one = F.when(F.col("kind").startswith("given") | (F.col("kind") == "initial"), 0).otherwise(1)
    new = (
        occurs.join(known, ["kind", "normal"], "left")
        .select("__key", "__at", new.alias("new"), one.alias("one"))
        .groupBy("__key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "new"))), lambda x: x["new"]).alias("__new"), F.sum("one").cast("int").alias("__count"))
    )
    between = F.split(F.col(text), pattern_of(F.col("__known")), -1)
    woven = F.array_join(F.flatten(F.zip_with(between, F.col("__new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    rewritten = marked.join(new, "__key").withColumn(text, woven)
    return plain.unionByName(rewritten.select(*columns, *([F.col("__count").alias(count)] if count else [])))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key="varioflow-op10", count="n_entities")


QUERIES = {"op10_pii_surrogates": op10_pii_surrogates}
ORACLES: dict[str, str] = {}
