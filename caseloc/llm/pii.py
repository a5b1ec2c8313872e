"""Personal data: detection and keyed surrogates, in DataFrame functions only.

Each entity has a key "type|canonical form", so spellings of one entity (case of
an address, layout of a telephone number, a name with or without a given name)
share a surrogate over the whole corpus: coreference survives. A surrogate is
drawn from a keyed hash of the entity and has its type, script, gender and
format. Draws are checked over the whole corpus: a surrogate that another entity
holds, or that is itself an entity of the corpus, is drawn anew until all are
distinct. Where the corpus uses more than an eighth of the values of a format
(192.168.0.0/16 has 65,536), its entities go through a keyed permutation of that
format instead: distinct by construction and never the entity itself, but it may
be some other entity's value, which such a format can't avoid.

A text is cut once by the patterns and written with its parts; only mentions are
exploded and shuffled, and a text with some is joined once with its surrogates.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Production callers pass their own secret key.
DEFAULT_KEY = "caseloc-surrogates"
#: From this attempt on, a local part or name gets longer with each attempt.
WIDEN_AT, LONGER = 4, 8
#: A format is permuted if the corpus uses more than this share of its values.
DENSE = 1 / 8
#: Stands at the cuts of a text; a text that has it is cut by a slower way.
MARK = "\ufdd0"

# Titles by gender, and given names by script and gender.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Господин|господин|Г-н|г-н|Κύριος|κύριος"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Mme|Señora|Señorita|Sra|Госпожа|госпожа|Г-жа|г-жа|Κυρία|κυρία"
NEUTRAL_TITLES = "Dr|Prof|Mx"
GIVEN = {
    ("latin", "m"): "Adam Alan Bruno Carl David Emil Felix Hugo Ivan James Karl Leon Marco Nils Oscar Paul Rolf Simon Tomas Victor",
    ("latin", "f"): "Ada Alba Anna Clara Diana Elena Flora Greta Helen Irene Julia Laura Maria Nora Olga Petra Rosa Sofia Teresa Vera",
    ("latin", "n"): "Alex Andrea Chris Dana Eden Jamie Jordan Kim Lee Morgan Noel Pat Quinn Robin Sam Sasha Sky Taylor Toni Val",
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Николай Олег Павел Роман Семён Фёдор",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса София Юлия",
    ("cyrillic", "n"): "Саша Женя Валя Слава",
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μάριος Νίκος Πέτρος Στέλιος",
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νεφέλη Σοφία",
    ("greek", "n"): "Φώτης Χαρά",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve wa",
    "cyrillic": "ба бе бо ва ве го да де до ка ке ко ла ле ли ло ма ме ми мо на не но па пе ра ре ро са се со та те то",
    "greek": "βα βε γα γε δα δε θα κα κε λα λε μα με να νε πα πε ρα ρε σα σε τα τε φα",
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,63}+@(?:[\p{L}\p{N}\-]{1,63}+\.){1,6}\p{L}{2,18}"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}])(?!\.\d)"
NUMBER = r"(?<![\p{L}\p{N}_.+])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])"
PHONE = (
    r"(?<![\p{L}\p{N}.+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}"
    r"|\(\d{3}\) ?\d{3}[ .\-]?\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\p{L}\p{N}])"
)
#: Eight groups of hexadecimal digits, or fewer and one gap; three groups at least.
IP6 = (
    r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,40}::|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f])"
    r"(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![\p{L}\p{N}:])"
)
_TITLES = f"(?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})"
#: No group repeats without a bound: Java calls itself for each turn of one.
NAME_WORD = r"\p{Lu}(?:\p{L}++|(?=['’\-]\p{L}))(?:['’\-]\p{L}++){0,4}+"
INITIALS = r"(?:\p{Lu}\.){1,3}"
#: A title, then initials and one to three words, or a single letter.
NAME = (
    rf"(?<![\p{{L}}\p{{N}}]){_TITLES}\.? (?:(?:{INITIALS} ){{0,3}}{NAME_WORD}(?: (?:{INITIALS} )?{NAME_WORD}){{0,2}}"
    r"|[\p{Lu}&&[^AI]](?![\p{L}\p{N}'’\-]|\.\p{L}))"
)
PATTERN = "|".join((EMAIL, IBAN, IP, IP6, SSN, NUMBER, PHONE, NAME))
#: A capitalised word, which may be of a name that the text has with a title elsewhere.
CAPITALS = rf"(?<![\p{{L}}\p{{N}}])(?!{_TITLES}\.? ){NAME_WORD}(?![\p{{L}}\p{{N}}@]|[._%+\-]+[\p{{L}}\p{{N}}._%+\-]*@)"


def _whole(m: Column, pattern: str) -> Column:
    return m.rlike(f"^(?:{pattern})$")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def kind_of(m: Column) -> Column:
    """Type of a match; null if it only looks like one (an address with a part
    over 255)."""
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    groups = F.size(F.filter(F.split(m, ":"), lambda x: x != ""))
    gaps = F.size(F.split(m, "::")) - 1
    edges = m.rlike("^:[^:]|[^:]:$") | m.contains(":::")
    return (
        F.when(m.contains("@"), "email")
        .when(_whole(m, IP6), F.when(~edges & (((gaps == 1) & groups.between(3, 7)) | ((gaps == 0) & (groups == 8))), "ip6"))
        .when(_whole(m, IP), F.when(F.forall(octets, lambda x: x <= 255), "ip"))
        .when(_whole(m, IBAN), "iban")
        .when(_whole(m, SSN), "ssn")
        .when(m.startswith("+") | m.startswith("(") | _whole(m, r"\d{3}[\-.]\d{3}[\-.]\d{4}"), "phone")
        .when(_whole(m, NUMBER), "number")
        .when(_whole(m, NAME), "name")
        .when(m.rlike(r"^\p{Lu}"), "capitals")
    )


def _script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").when(s.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(title: Column) -> Column:
    return F.when(title.rlike(rf"^(?:{MALE_TITLES})\.?$"), "m").when(title.rlike(rf"^(?:{FEMALE_TITLES})\.?$"), "f").otherwise("n")


def _plain(w: Column) -> Column:
    """A word of a name in lower case, without a genitive ending."""
    return F.lower(F.regexp_replace(w, "['’]s$", ""))


def entities(m: Column, after: Column) -> Column:
    """The entities of a match, in order: structs of raw (the plain word of a
    name), next (the word after it), gender (of a title) and key. One for most types,
    one for each word of a name (the last is the family name; before gender is
    settled, key lacks it), and for a capitalised word one without key. after: the
    match behind it, if there is but a blank between."""
    kind = kind_of(m)
    words = F.split(m, " ")
    gender = _gender(F.get(words, F.lit(0)))

    def word(own: Column, gender: Column, named: bool):
        def one(w: Column, i: Column) -> Column:
            last = i == F.size(own) - 1
            part = F.when(_whole(w, INITIALS), "initial|").when(last, "family|").otherwise("given|")
            key = F.concat(part, _plain(w)) if named else F.lit(None).cast("string")
            return F.struct(_plain(w).alias("raw"), _plain(F.coalesce(F.get(own, i + 1), after)).alias("next"), gender.alias("gender"), key.alias("key"))

        return F.transform(own, one)

    canonical = (
        F.when(kind == "phone", F.substring(_digits(m), -10, 10))
        .when(kind.isin("number", "ssn"), _digits(m))
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .otherwise(F.lower(m))
    )
    none = F.lit(None).cast("string")
    single = F.struct(m.alias("raw"), none.alias("next"), none.alias("gender"), F.concat(kind, F.lit("|"), canonical).alias("key"))
    return (
        F.when(kind == "name", word(F.slice(words, 2, F.size(words) - 1), gender, True))
        .when(kind == "capitals", word(words, none, False))
        .otherwise(F.array(single))
    )


# --- drawing a surrogate ------------------------------------------------------


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )


def _number_at(digest: Column, i: Column) -> Column:
    """The i-th pseudo-random number below 2^24 of a hex digest of 64 digits
    (a new digest would be needed beyond about 58 of them; texts repeat there)."""
    return F.conv(F.substring(digest, i * 5 % 58 + 1, F.lit(6)), 16, 10).cast("long")


def _pick(digest: Column, i: Column, values: str) -> Column:
    return F.substring(F.lit(values), (_number_at(digest, i) % len(values)).cast("int") + 1, F.lit(1))


def _same_format(s: Column, digest: Column) -> Column:
    """Letters become letters of their script and case, digits digits."""

    def one(c: Column, i: Column) -> Column:
        low = (
            F.when(c.rlike(r"\p{IsCyrillic}"), _pick(digest, i, ALPHABETS["cyrillic"]))
            .when(c.rlike(r"\p{IsGreek}"), _pick(digest, i, ALPHABETS["greek"]))
            .otherwise(_pick(digest, i, ALPHABETS["latin"]))
        )
        return F.when(c.rlike(r"\d"), _pick(digest, i, "0123456789")).when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c)

    return F.array_join(F.transform(_chars(s), one), "")


def _stream(digest: Column) -> Column:
    """60 decimal digits of a digest."""
    part = lambda k: F.substring(F.lpad(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10), 19, "0"), 5, 15)
    return F.concat(*[part(k) for k in range(4)])


def _not_small(d: Column) -> Column:
    return F.when(d < "2", (d.cast("int") + 4).cast("string")).otherwise(d)


def luhn(s: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    doubled = F.transform(
        _chars(F.reverse(s)),
        lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + (c.cast("int") >= 5).cast("int")).otherwise(c.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _mod97(s: Column) -> Column:
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    return F.aggregate(
        _chars(turned),
        F.lit(0),
        lambda a, c: F.when(c.rlike(r"\d"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def turned_initials(key: Column, secret: str) -> Column:
    """Each letter of initials moved on in its alphabet by a number that the secret
    gives, so different initials stay different."""
    by = F.conv(F.substring(F.sha2(F.concat_ws("\u0001", F.lit(secret), F.lit("initial")), 256), 1, 6), 16, 10).cast("long")

    def one(c: Column) -> Column:
        out = c
        for letters in ALPHABETS.values():
            at = F.instr(F.lit(letters), c)
            step = 1 + by % (len(letters) - 1)
            out = F.when(at > 0, F.substring(F.lit(letters), ((at - 1 + step) % len(letters)).cast("int") + 1, F.lit(1))).otherwise(out)
        return F.upper(out)

    return F.array_join(F.transform(_chars(F.regexp_replace(key, r"^[^|]*\|", "")), one), "")


def _name_pick(digest: Column, i: int, values: str) -> Column:
    names = values.split()
    return F.element_at(F.array(*map(F.lit, names)), (_number_at(digest, F.lit(i)) % len(names)).cast("int") + 1)


def draw(key: Column, attempt: Column, secret: str) -> Column:
    """The surrogate (in canonical form) of an entity at this attempt."""
    kind, canon = F.substring_index(key, "|", 1), F.regexp_replace(key, r"^[^|]*\|", "")
    digest = F.sha2(F.concat_ws("\u0001", F.lit(secret), key, attempt.cast("string")), 256)
    wide = attempt >= WIDEN_AT
    more = lambda pick: F.concat(*[F.when(attempt >= WIDEN_AT + i, pick(i)).otherwise("") for i in range(LONGER)])
    stream, n = _stream(digest), F.length(canon)
    at = lambda k: F.substring(stream, k, 1)
    phone = F.concat(_not_small(at(1)), at(2), at(3), _not_small(at(4)), F.substring(stream, F.lit(5), F.greatest(n - 4, F.lit(0))))
    body = F.concat(F.substring(canon, 1, 1), F.substring(stream, F.lit(1), n - 2))
    check = ((F.lit(10) - luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    other = ((check.cast("int") + 1 + at(40).cast("int") % 9) % 10).cast("string")
    number = F.concat(body, F.when(luhn(canon) == 0, check).otherwise(other))
    octet = lambda i: (_number_at(digest, F.lit(i)) % 256).cast("string")
    first = _number_at(digest, F.lit(4)) % 99 + F.lit(11)
    private = F.regexp_extract(canon, r"^(10|127|192\.168)\.", 1)
    ip = F.when(private == "192.168", F.concat_ws(".", private, octet(1), octet(2))).when(
        private != "", F.concat_ws(".", private, octet(1), octet(2), octet(3))
    ).otherwise(F.concat_ws(".", first.cast("string"), octet(1), octet(2), octet(3)))
    hexadecimal = lambda i: F.concat(_pick(digest, i * 4, "123456789abcdef"), *[_pick(digest, i * 4 + j, "0123456789abcdef") for j in (1, 2, 3)])
    ip6 = F.array_join(F.transform(F.split(canon, ":"), lambda x, i: F.when(x == "", x).otherwise(hexadecimal(i))), ":")
    account = _same_format(F.substring(canon, F.lit(5), n), digest)
    blank = F.concat(F.substring(canon, 1, 2), F.lit("00"), account)
    iban = F.concat(F.substring(canon, 1, 2), F.lpad((F.lit(98) - _mod97(blank)).cast("string"), 2, "0"), account)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    # The host's surrogate does not depend on the person: a shared host stays shared.
    email = F.concat(
        _same_format(local, digest),
        more(lambda i: _pick(digest, F.lit(50 + i), ALPHABETS["latin"])),
        F.lit("@"),
        _same_format(host, F.sha2(F.concat_ws("\u0001", F.lit(secret), F.lit("host"), host), 256)),
        top,
    )
    given = family = None
    for script in ("cyrillic", "greek", "latin"):
        is_script = _script(canon) == script
        syllables = SYLLABLES[script]
        made = F.initcap(F.concat(*[_name_pick(digest, i, syllables) for i in range(3)], more(lambda i: _name_pick(digest, 20 + i, syllables))))
        for gender in "mfn":
            value = _name_pick(digest, 9, GIVEN[script, gender])
            value = F.when(wide, F.concat(value, F.lit("-"), made)).otherwise(value)
            test = is_script & (kind == f"given_{gender}")
            given = F.when(test, value) if given is None else given.when(test, value)
        family = F.when(is_script, made) if family is None else family.when(is_script, made)
    return (
        F.when(kind == "phone", phone)
        .when(kind == "number", number)
        .when(kind == "ssn", F.concat(_not_small(at(1)), F.substring(stream, 2, 8)))
        .when(kind == "ip", ip)
        .when(kind == "ip6", ip6)
        .when(kind == "iban", iban)
        .when(kind == "email", email)
        .when(kind == "family", family)
        .otherwise(given)
    )


# --- formats with few values --------------------------------------------------


def _classes(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\d", "0"), r"[A-Za-z]", "A")


def value_space(key: Column) -> Column:
    """(name, size) of the format that surrogates of ``key`` are drawn from;
    null where they can be lengthened."""
    kind, canon = F.substring_index(key, "|", 1), F.regexp_replace(key, r"^[^|]*\|", "")
    n, ten = F.length(canon), F.lit(10.0)
    private = F.regexp_extract(canon, r"^(10|127|192\.168)\.", 1)
    account = _classes(F.substring(canon, F.lit(5), n))
    letters = F.length(F.replace(account, F.lit("0"), F.lit("")))
    valid = luhn(canon) == 0
    space = lambda size, *name: F.struct(F.concat_ws("|", kind, *name).alias("name"), size.cast("double").alias("size"))
    return (
        F.when(kind == "phone", space(64 * F.pow(ten, n - 2), n.cast("string")))
        .when(kind == "ssn", space(F.lit(8e8)))
        .when(kind == "number", space(F.when(valid, 1).otherwise(9) * F.pow(ten, n - 2), F.substring(canon, 1, 1), n.cast("string"), valid.cast("string")))
        .when(kind == "ip", space(F.when(private == "192.168", 65536.0).when(private != "", 2.0**24).otherwise(99 * 2.0**24), private))
        .when(kind == "iban", space(F.pow(ten, F.length(account) - letters) * F.pow(F.lit(26.0), letters), F.substring(canon, 1, 2), account))
    )


def permuted(key: Column, secret: str, rounds: int = 6) -> Column:
    """The value that a keyed permutation of the format of ``key`` gives it.

    The free digits, letters or octets are symbols. In each round those of one
    half are turned by a hash of the other half; then the first symbol goes up
    by one and the rounds are taken back. So different values stay different,
    none stays what it is, and the format is kept.
    """
    kind, canon = F.substring_index(key, "|", 1), F.regexp_replace(key, r"^[^|]*\|", "")
    n = F.length(canon)
    octets = F.split(canon, r"\.")
    fixed = F.when(canon.startswith("192.168."), 2).otherwise(1)
    body = F.when(kind == "number", F.substring(canon, F.lit(2), n - 2)).when(kind == "iban", F.substring(canon, F.lit(5), n)).otherwise(canon)
    is_digit = lambda c: c.rlike(r"\d")
    chars = _chars(body)
    values = F.when(kind == "ip", F.transform(F.slice(octets, fixed + 1, 4), lambda x: x.cast("long"))).otherwise(
        F.transform(chars, lambda c: F.when(is_digit(c), c.cast("long")).otherwise(F.ascii(F.upper(c)).cast("long") - 65))
    )
    radix = lambda i: F.when(kind == "ip", 256).otherwise(F.when(is_digit(F.get(chars, i)), 10).otherwise(26))

    def step(v: Column, t: Column) -> Column:
        back = t > rounds
        turn = F.when(back, 2 * rounds - t).otherwise(t)
        first = lambda i: (i < F.floor(F.size(v) / 2)) == (turn % 2 == 0)
        other = F.array_join(F.transform(F.filter(v, lambda x, i: ~first(i)), lambda x: x.cast("string")), ",")

        def one(x: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("\u0001", F.lit(secret), kind, turn.cast("string"), i.cast("string"), other), 256)
            by = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
            return (
                F.when(t == rounds, F.when(i == 0, F.pmod(x + 1, radix(i))).otherwise(x))
                .when(first(i), F.pmod(x + F.when(back, -by).otherwise(by), radix(i)))
                .otherwise(x)
            )

        return F.transform(v, one)

    steps = F.array(*[F.lit(t) for t in range(2 * rounds + 1)])
    moved = F.aggregate(steps, values, step)
    shown = F.array_join(
        F.transform(moved, lambda x, i: F.when((kind == "ip") | is_digit(F.get(chars, i)), x.cast("string")).otherwise(F.char(x + 65))), ""
    )
    # Check digits keep their distance from the valid ones, so valid stays valid.
    check = lambda s: (10 - luhn(F.concat(s, F.lit("0")))) % 10
    last = F.substring(canon, -1, 1).cast("int") - check(F.substring(canon, F.lit(1), n - 1))
    number = F.concat(F.substring(canon, 1, 1), shown)
    country = F.substring(canon, 1, 2)
    pair = lambda account: F.lit(98) - _mod97(F.concat(country, F.lit("00"), account))
    off = F.substring(canon, 3, 2).cast("int") - pair(body)
    return (
        F.when(kind == "ip", F.concat_ws(".", F.slice(octets, F.lit(1), fixed), F.transform(moved, lambda x: x.cast("string"))))
        .when(kind == "number", F.concat(number, F.pmod(check(number) + last, F.lit(10)).cast("string")))
        .when(kind == "iban", F.concat(country, F.lpad(F.pmod(pair(shown) + off, F.lit(100)).cast("string"), 2, "0"), shown))
        .otherwise(shown)
    )


def surrogates(entities: DataFrame, secret: str = DEFAULT_KEY) -> DataFrame:
    """(key, surrogate) for each distinct entity key (key), all surrogates of a
    type distinct and none that of its own entity. Outside dense formats none is
    an entity of the corpus.

    Each round draws for the entities still without a surrogate, on their table
    only; the smallest key wins a contested surrogate, the others draw again. A
    round that leaves nobody over ends it, most often the first or second; in
    the fullest format a draw is free with a chance of 3/4 or more.
    """
    group = lambda key: F.regexp_replace(F.substring_index(key, "|", 1), "^given_.*", "given")
    entities = written(entities.select("key").distinct().withColumn("space", value_space(F.col("key"))), "pii-entities")
    taken = entities.select(group(F.col("key")).alias("kind"), F.lower(F.regexp_replace("key", r"^[^|]*\|", "")).alias("form"))
    # A dense format holds at least 8,000 entities, so there are few.
    full = entities.where("space is not null").groupBy("space").agg(F.count("*").alias("n")).where(F.col("n") > F.col("space.size") * DENSE)
    dense = [r["name"] for r in full.select("space.name").collect()]
    done, pending = None, entities.select("key")
    if dense:
        in_dense = F.coalesce(F.col("space.name").isin(dense), F.lit(False))
        done = written(entities.where(in_dense).select("key", permuted(F.col("key"), secret).alias("surrogate")), "pii-permuted")
        taken = taken.unionByName(done.select(group(F.col("key")).alias("kind"), F.lower("surrogate").alias("form")))
        pending = entities.where(~in_dense).select("key")
    for attempt in itertools.count():
        drawn = pending.select("key", draw(F.col("key"), F.lit(attempt), secret).alias("surrogate")).select(
            "*", group(F.col("key")).alias("kind"), F.lower("surrogate").alias("form")
        )
        drawn = written(drawn, "pii-drawn")
        free = drawn.join(taken, ["kind", "form"], "left_anti")
        won = written(free.groupBy("kind", "form").agg(F.min_by(F.struct("key", "surrogate"), "key").alias("x")).select("x.*", "kind", "form"), "pii-won")
        done = won.select("key", "surrogate") if done is None else done.unionByName(won.select("key", "surrogate"))
        taken = taken.unionByName(won.select("kind", "form"))
        pending = drawn.select("key").join(won.select("key"), "key", "left_anti")
        if pending.isEmpty():
            return done


# --- texts ---------------------------------------------------------------------


def _render(m: Column, found: Column) -> Column:
    """The match with its entities replaced, in its own layout. found: their
    surrogates, in order; null where a word is no entity."""
    kind = kind_of(m)
    own = F.get(found, F.lit(0))
    size = F.length(own)
    # Digits are aligned at the right; a country code before them stays.
    in_layout = F.array_join(
        F.transform(
            _chars(m),
            lambda c, i: F.when(
                c.rlike(r"\d"),
                F.coalesce(
                    F.when(
                        F.length(_digits(F.substring(m, i + 1, F.length(m)))) <= size,
                        F.substring(own, size - F.length(_digits(F.substring(m, i + 1, F.length(m)))) + 1, F.lit(1)),
                    ),
                    c,
                ),
            ).otherwise(c),
        ),
        "",
    )
    spaced = F.array_join(
        F.transform(
            _chars(m),
            lambda c, i: F.when(c == " ", c).otherwise(
                F.substring(own, F.length(F.replace(F.substring(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))
            ),
        ),
        "",
    )
    words = F.split(m, " ")
    in_case = lambda raw, new: F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(new)).otherwise(new)

    def replaced(ahead: int) -> Column:
        def one(new: Column, i: Column) -> Column:
            word = F.get(words, i + ahead)
            return F.coalesce(F.concat(in_case(word, new), F.regexp_extract(word, "['’]s$", 0)), word)

        return F.transform(found, one)

    return (
        F.when(kind.isin("phone", "number", "ssn"), in_layout)
        .when(kind == "iban", spaced)
        .when(kind == "name", F.concat_ws(" ", F.get(words, F.lit(0)), replaced(1)))
        .when(kind == "capitals", F.concat_ws(" ", replaced(0)))
        .when(kind.isin("email", "ip6"), in_case(m, own))
        .when(kind.isNotNull(), own)
    )


def _parts(text: Column, pattern: str) -> Column:
    """The text cut at the matches: gap, match, gap, ..., gap."""
    quick = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    slow = F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    return F.when(text.contains(MARK), slow).otherwise(quick)


def _matches(parts: Column) -> Column:
    return F.filter(parts, lambda p, i: i % 2 == 1)


def _keyed(cut: DataFrame) -> DataFrame:
    """(_id, n, w, key): each word or entity of each match of ``cut``; key null
    if it is none.

    A given name's key has the gender of its title. With a neutral title it has
    that of the same full name elsewhere in the corpus, if only one is found. A
    name without title counts in a text that has it with one: the family name
    alone, and words before it as they stand there.
    """
    after = lambda i: F.when(F.get("_parts", i + 1) == " ", F.get("_parts", i + 2))
    each = F.transform("_parts", lambda p, i: F.when(i % 2 == 1, F.struct(p.alias("m"), after(i).alias("after"))))
    found = cut.where(F.size("_parts") > 1).select("_id", F.posexplode(F.filter(each, lambda x: x.isNotNull())).alias("n", "x")).select("_id", "n", "x.*")
    whole = _plain(F.regexp_replace("m", r"^\S+ ", "")).alias("whole")
    named = found.select("_id", "n", whole, F.posexplode(entities(F.col("m"), F.col("after"))).alias("w", "x"))
    words = written(named.select("_id", "n", "w", "x.*", "whole"), "pii-words")
    given = words.where("key like 'given|%'")
    known = given.where("gender <> 'n'").groupBy("whole").agg(F.min("gender").alias("low"), F.max("gender").alias("high")).where("low = high")
    neutral = given.where("gender = 'n'").join(known.select("whole", F.col("low").alias("other")), "whole", "left")
    settled = given.where("gender <> 'n'").withColumn("other", F.col("gender")).unionByName(neutral)
    settled = settled.withColumn(
        "key", F.concat(F.lit("given_"), F.coalesce("other", "gender"), F.lit("|"), F.regexp_replace("key", r"^given\|", ""))
    ).select("_id", "n", "w", "raw", "next", "key")
    families = words.where("key like 'family|%'").groupBy("_id", "raw").agg(F.min("key").alias("family"))
    before = settled.groupBy("_id", "raw", "next").agg(F.min("key").alias("given"))
    untitled = (
        words.where("key is null")
        .select("_id", "n", "w", "raw", "next")
        .join(families, ["_id", "raw"], "left")
        .join(before, ["_id", "raw", "next"], "left")
        .select("_id", "n", "w", F.coalesce("given", "family").alias("key"))
    )
    others = words.where("key not like 'given|%'").select("_id", "n", "w", "key")
    return others.unionByName(settled.select("_id", "n", "w", "key")).unionByName(untitled)


def pseudonymize(docs: DataFrame, secret: str = DEFAULT_KEY, count: str | None = None) -> DataFrame:
    """``docs`` (all columns) with personal data in ``text`` replaced, and if
    ``count`` is given a column of that name with the number of mentions.

    Null and empty texts stay as they are. Equal texts stay equal; repeated rows
    stay; a very long text costs in proportion to its length and mentions.
    n_chars and other columns are not touched.

    Found are e-mail addresses, IBANs, IPv4 and IPv6 addresses (three groups or
    more; other spellings of one IPv6 address are other entities), social security
    numbers, card-like numbers, telephone numbers, and names of people with a title
    (O'Neil, D'Angelo, double names, initials, a single letter but A and I). The
    same name without title is replaced in the same text (in any case, with or
    without a genitive ending), a given name, initials or a letter alone are not.
    Initials become other initials, the same everywhere. Any number of entities has
    surrogates; see ``surrogates``.
    """
    rest = [c for c in docs.columns if c != "text"]
    text = F.col("_text")
    packed = docs.select(F.struct(*(rest or [F.lit(0)])).alias("_row"), F.col("text").cast("string").alias("_text"))
    first = packed.withColumn("_parts", _parts(text, PATTERN))
    with_name = F.exists(_matches(F.col("_parts")), lambda m: _whole(m, NAME))
    again = F.when(with_name, _parts(text, f"{PATTERN}|{CAPITALS}")).otherwise(F.col("_parts"))
    cut = written(first.select(F.monotonically_increasing_id().alias("_id"), "_row", again.alias("_parts")), "pii-cut")

    keyed = written(_keyed(cut), "pii-keyed")
    is_initial = F.col("key").startswith("initial|")
    initials = keyed.where(is_initial).select("_id", "n", "w", turned_initials(F.col("key"), secret).alias("surrogate"))
    keys = keyed.where(F.col("key").isNotNull() & ~is_initial)
    drawn = keys.join(surrogates(keys.select("key"), secret), "key")
    every = drawn.select("_id", "n", "w", "surrogate").unionByName(
        keyed.where("key is null").select("_id", "n", "w", F.lit(None).cast("string").alias("surrogate"))
    ).unionByName(initials)
    # As many entries as the text has words of entities, in the order of its matches.
    by_match = every.groupBy("_id", "n").agg(F.sort_array(F.collect_list(F.struct("w", "surrogate"))).alias("x"))
    own = by_match.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("n", F.col("x.surrogate").alias("new")))).alias("_new"))
    new = lambda i: F.get(F.col("_new"), F.floor(i / 2).cast("int"))["new"]
    shown = F.transform("_parts", lambda p, i: F.when(i % 2 == 1, F.coalesce(_render(p, new(i)), p)).otherwise(p))
    mentions = F.size(F.filter("_new", lambda x: F.exists(x["new"], lambda s: s.isNotNull())))
    has = F.coalesce(F.size("_parts") > 1, F.lit(False))
    replaced = cut.where(has).join(own, "_id").select("_row", mentions.alias("_count"), F.array_join(shown, "").alias("_text"))
    clean = cut.where(~has).select("_row", F.lit(0).alias("_count"), F.get("_parts", F.lit(0)).alias("_text"))
    out = replaced.unionByName(clean)
    columns = [F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    if count:
        columns.append(F.col("_count").alias(count))
    return out.select(*columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_mentions")
