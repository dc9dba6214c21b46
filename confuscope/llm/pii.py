"""Surrogates for personal data, with DataFrame functions only.

One pattern finds the entities of a text. What makes an entity unique are its *atoms*: each name of a person, a
mail address's domain and mailbox, the digits of a number without its punctuation. A keyed hash (SHA-256 over key,
type, atom and attempt) makes the surrogate of an atom, so an atom has the same surrogate wherever and however
it is written: names keep it under other titles and without given names, numbers in other groupings, addresses in
other cases. A surrogate keeps type and format: digits stay digits, letters keep case, punctuation stays; card numbers
and IBANs stay valid, addresses stay addresses, names keep title, script and the gender that the title or the
given name's ending shows.

The distinct atoms of the corpus are checked: a surrogate that another atom has, or that is real, is made anew with the
next attempt. From some attempt on surrogates grow (names get more syllables, numbers and words more characters, addresses
of a small network move to a larger one), so there are always enough of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col_of, fresh, written

# What the patterns accept and what surrogates are made of.
TITLES_FEMALE = ("Mrs", "Ms", "Miss", "Mme", "Frau", "Sra", "Señora", "Madame", "Signora", "Г-жа", "Госпожа")
TITLES_MALE = ("Mr", "Herr", "Sr", "Señor", "Monsieur", "Signor", "Г-н", "Господин")
TITLES_OPEN = ("Dr", "Prof")
LATIN_STARTS = ("Bal", "Cor", "Dan", "Fen", "Gar", "Hol", "Jan", "Kel", "Lor", "Mar", "Nor", "Pel", "Rod", "Sal", "Tor", "Ver")
LATIN_MIDDLES = ("ab", "ed", "il", "on", "ur", "am", "er", "in", "ol", "us", "ar", "en", "is", "or", "un", "al")
LATIN_ENDS_FEMALE = ("a", "ia", "ella", "ina")
LATIN_ENDS_MALE = ("o", "us", "an", "ert")
LATIN_ENDS_FAMILY = ("son", "er", "ton", "man")
CYRILLIC_STARTS = ("Бал", "Вер", "Гор", "Дан", "Зар", "Кор", "Лад", "Мир", "Нов", "Пет", "Род", "Сав", "Тим", "Фед", "Хар", "Яр")
CYRILLIC_MIDDLES = ("ав", "ед", "ил", "он", "ур", "ам", "ер", "ин", "ол", "ус", "ар", "ен", "ис", "ор", "ун", "ал")
CYRILLIC_ENDS_FEMALE = ("а", "ия", "ина", "ова")
CYRILLIC_ENDS_MALE = ("ов", "ин", "ий", "ан")


_TITLE = "|".join(sorted(TITLES_FEMALE + TITLES_MALE + TITLES_OPEN, key=lambda t: (-len(t), t)))
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:-\p{Lu}\p{Ll}+)?"
_INITIALS = r"(?:[A-ZА-Я]\.){1,3}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GROUP = r"[0-9A-Fa-f]{1,4}"
_SECRET_HEAD = r"(?i:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?"
_TOKEN_HEAD = r"gh[pousr]_|sk-|xox[baprs]-|AIza"
#: Country codes of telephone numbers: one, two or three digits.
_COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Types with their patterns, the first that fits decides.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("EMAIL", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,9}[A-Za-z]{2,24}"),
    ("SECRET", _SECRET_HEAD + r"[A-Za-z0-9+/_-]{8,}"),
    ("AWS_KEY", r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    ("TOKEN", rf"(?:{_TOKEN_HEAD})[A-Za-z0-9_-]{{20,}}"),
    ("IPV6", rf"(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{2,6}}(?::{_GROUP}){{1,4}}"),
    ("IP", rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)"),
    ("IBAN", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("SSN", r"\d{3}-\d{2}-\d{4}(?!\d)"),
    ("CARD", r"(?:\d{4}[ -]){3}\d{4}(?!\d)|\d{13,19}(?!\d)"),
    ("PHONE", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)|0\d{2,4}[ -]\d{3,4}[ -]\d{4}(?!\d)"),
    ("PERSON", rf"(?:{_TITLE})\.?\s(?:{_INITIALS}\s){{0,2}}{_NAME}(?:\s(?:{_INITIALS}\s)?{_NAME}){{0,2}}"),
)
PATTERN = dict(PATTERNS)
#: What every entity has, a sign or a word; texts with none of them are left alone unread by the longer pattern.
SIGNS, WORDS = "[0-9@=:]", (*TITLES_FEMALE, *TITLES_MALE, *TITLES_OPEN, "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "AIza")
ENTITY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(p for _, p in PATTERNS) + ")"
#: Separators of numbers, and of the parts of an atom's name.
_MARKS, SEP = " ()+-./", "\x1f"
#: The attempt from which on surrogates grow.
GROW = 3


@dataclass(frozen=True)
class Key:
    """Secret of the replacement; who has it can link, but not invert, surrogates."""

    secret: str

    def stream(self, kind: Column | str, value: Column, attempt: Column, block: int = 0) -> Column:
        """64 hex digits."""
        return F.sha2(F.concat_ws(SEP, F.lit(self.secret), F.lit(kind) if isinstance(kind, str) else kind, value, attempt.cast("string"), F.lit(str(block))), 256)

    def rotation(self, alphabet: str) -> str:
        """The alphabet turned by a number of places that the key names, never by none."""
        n = 1 + int(sha256((self.secret + SEP + alphabet).encode()).hexdigest(), 16) % (len(alphabet) - 1)
        return alphabet[n:] + alphabet[:n]


def entity_type(value: Column) -> Column:
    kinds = [F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS]
    return F.coalesce(*kinds, F.lit("OTHER"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, not wherever the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ------------------------------------------------------------------------------------------ shared means


def _byte(stream: Column, i: Column) -> Column:
    """Byte ``i`` (from 0, cyclic over the stream) as an int."""
    at = F.pmod(i, F.lit(96)) * 2 + 1
    hexed = F.substring(stream, at, F.lit(2))
    digit = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    return digit(F.substring(hexed, 1, 1)) * 16 + digit(F.substring(hexed, 2, 1))


def _long_stream(key: Key, kind: Column | str, value: Column, attempt: Column) -> Column:
    return F.concat(*[key.stream(kind, value, attempt, b) for b in range(3)])


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_CYRILLIC_UPPER = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"


def _reshape(value: Column, stream: Column, keep: int = 0, hexed: bool = False) -> Column:
    """Each digit becomes a digit, each ASCII letter one of its case; the first ``keep`` characters stay."""

    def one(c: Column, i: Column, n: Column) -> Column:
        lower = F.when(c.rlike("[a-f]"), _pick(_HEX, n)).otherwise(_pick(_LOWER, n)) if hexed else _pick(_LOWER, n)
        digit = _pick(_HEX, n) if hexed else _pick(_DIGITS, n)
        return (
            F.when(i < keep, c).when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), _pick(_UPPER, n)).otherwise(c)
        )

    return _let(stream, lambda s: F.array_join(F.transform(F.split(value, ""), lambda c, i: _let(_byte(s, i), lambda n: one(c, i, n))), ""))


def _extra(alphabet: str, stream: Column, attempt: Column) -> Column:
    """A character more for each attempt beyond GROW."""
    some = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - GROW, F.lit(1))), lambda k: _pick(alphabet, _byte(stream, 95 - k))), "")
    return F.when(attempt > GROW, some).otherwise(F.lit(""))


def _grown(value: Column, stream: Column, attempt: Column, alphabet: str, keep: int = 0, hexed: bool = False) -> Column:
    return _let(stream, lambda s: F.concat(_reshape(value, s, keep, hexed), _extra(alphabet, s, attempt)))


def _bare(value: Column) -> Column:
    return F.translate(value, _MARKS, "")


def _lay(value: Column, made: Column) -> Column:
    """``made`` in the grouping of ``value``: its characters take the places between the marks, what is left goes to
    the end."""
    place = lambda i: F.length(_bare(F.substring(value, F.lit(1), i))) + 1
    laid = F.transform(F.split(value, ""), lambda c, i: F.when(F.length(_bare(c)) == 0, c).otherwise(F.substring(made, place(i), F.lit(1))))
    return F.concat(F.array_join(laid, ""), F.substring(made, F.length(_bare(value)) + 1, F.length(made)))


# ------------------------------------------------------------------------------- surrogates by type of atom


def _mailbox(local: Column, address: Column, key: Key, attempt: Column) -> Column:
    return _grown(local, _long_stream(key, "MAILBOX", address, attempt), attempt, _LOWER)


def _domain(written_as: Column, domain: Column, key: Key, attempt: Column) -> Column:
    tld = F.substring_index(written_as, ".", -1)
    host = F.substring(written_as, F.lit(1), F.length(written_as) - F.length(tld) - 1)
    return F.concat(_grown(host, _long_stream(key, "DOMAIN", domain, attempt), attempt, _LOWER), F.lit("."), tld)


def _ip(value: Column, key: Key, attempt: Column) -> Column:
    """Private addresses stay private as long as there are enough of them; then networks grow, up to IPv6."""

    def made(s: Column) -> Column:
        byte = lambda k: _byte(s, F.lit(k))
        narrow = F.when(value.startswith("192.168."), F.lit("192.168"))
        private = F.when(value.rlike(r"^(?:10|127)\."), F.concat(F.substring_index(value, ".", 1), F.lit("."), byte(1).cast("string")))
        private = private.when(value.startswith("192.168."), F.concat(F.lit("10."), byte(1).cast("string")))
        public = F.concat((F.pmod(byte(0), F.lit(112)) + 11).cast("string"), F.lit("."), byte(1).cast("string"))
        front = F.coalesce(F.when(attempt <= GROW, narrow), F.when(attempt <= 2 * GROW, private), public)
        small = F.concat_ws(".", front, byte(2).cast("string"), (F.pmod(byte(3), F.lit(254)) + 1).cast("string"))
        return F.when(attempt <= 4 * GROW, small).otherwise(F.concat(F.lit("fd00:"), _groups(s, 7)))

    return _let(_long_stream(key, "IP", value, attempt), made)


def _groups(stream: Column, n: int) -> Column:
    """Groups of an IPv6 address without leading zeros."""
    group = lambda k: F.concat(_pick("123456789abcdef", _byte(stream, k + 40)), F.substring(stream, k * 4 + 1, F.lit(3)))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), group), ":")


def _ipv6(value: Column, key: Key, attempt: Column) -> Column:
    made = lambda s: F.when(attempt <= GROW, _reshape(F.translate(value, "0", "1"), s, hexed=True)).otherwise(_groups(s, 8))
    return _let(_long_stream(key, "IPV6", value, attempt), made)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits as ints, from the right, the last undoubled."""
    term = lambda d, i, n: F.when(F.pmod(n - i, F.lit(2)) == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return _let(digits, lambda all_: F.aggregate(F.transform(all_, lambda d, i: term(d, i, F.size(all_))), F.lit(0), lambda a, x: a + x))


def _ints(digits: Column) -> Column:
    return F.transform(F.split(digits, ""), lambda c: c.cast("int"))


def _card(digits: Column, key: Key, attempt: Column) -> Column:
    """The first digit stays, the last one makes the number valid."""
    made = _grown(digits, _long_stream(key, "CARD", digits, attempt), attempt, _DIGITS, keep=1)
    front = lambda m: F.substring(m, F.lit(1), F.length(m) - 1)
    check = lambda m: F.pmod(10 - F.pmod(_luhn_sum(_ints(F.concat(front(m), F.lit("0")))), F.lit(10)), F.lit(10))
    return _let(made, lambda m: F.concat(front(m), check(m).cast("string")))


def _mod97(text: Column) -> Column:
    """Remainder of the number that digits and letters (A is 10) spell."""
    step = lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97))
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban_rest(value: Column) -> Column:
    return F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))


def _iban(value: Column, key: Key, attempt: Column) -> Column:
    """The country stays, check digits make the number valid."""
    country, account = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    made = _grown(account, _long_stream(key, "IBAN", value, attempt), attempt, _DIGITS)
    check = lambda m: F.lpad((98 - _mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0")
    return _let(made, lambda m: F.concat(country, check(m), m))


def _digits(kind: Column | str, digits: Column, key: Key, attempt: Column) -> Column:
    return _grown(digits, _long_stream(key, kind, digits, attempt), attempt, _DIGITS)


def _tail(kind: Column | str, tail: Column, key: Key, attempt: Column) -> Column:
    s = _long_stream(key, kind, tail, attempt)
    hexed = _grown(F.lower(tail), s, attempt, _HEX, hexed=True)
    return F.when(tail.rlike("^[0-9a-f]+$"), hexed).when(tail.rlike("^[0-9A-F]+$"), F.upper(hexed)).otherwise(_grown(tail, s, attempt, _LOWER))


def _is_cyrillic(name: Column) -> Column:
    return name.rlike(r"^\p{IsCyrillic}")


def _item(items: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.split(F.lit(",".join(items)), ","), F.pmod(n, F.lit(len(items))) + 1)


def _stem(name: Column, stream: Column, attempt: Column) -> Column:
    """A name without its ending: a first syllable and two more, and one more for each attempt."""

    def made(starts: tuple[str, ...], middles: tuple[str, ...]) -> Column:
        more = F.transform(F.sequence(F.lit(1), attempt + 2), lambda k: _item(middles, _byte(stream, k)))
        return F.concat(_item(starts, _byte(stream, F.lit(0))), F.array_join(more, ""))

    return F.when(_is_cyrillic(name), made(CYRILLIC_STARTS, CYRILLIC_MIDDLES)).otherwise(made(LATIN_STARTS, LATIN_MIDDLES))


def _name(name: Column, given: Column, female: Column, key: Key, attempt: Column) -> Column:
    """The surrogate of one name (in lower case). Family names are written alike for both genders in Latin script."""

    def made(s: Column) -> Column:
        n = _byte(s, F.lit(95))
        gendered = lambda women, men: F.when(female, _item(women, n)).otherwise(_item(men, n))
        latin = F.when(given, gendered(LATIN_ENDS_FEMALE, LATIN_ENDS_MALE)).otherwise(_item(LATIN_ENDS_FAMILY, n))
        return F.concat(_stem(name, s, attempt), F.when(_is_cyrillic(name), gendered(CYRILLIC_ENDS_FEMALE, CYRILLIC_ENDS_MALE)).otherwise(latin))

    return _let(_long_stream(key, "NAME", name, attempt), made)


def _name_forms(name: Column, key: Key, attempt: Column) -> Column:
    """All that a name may become, with any ending."""
    ends = lambda items: F.split(F.lit(",".join(dict.fromkeys(items))), ",")
    latin, cyrillic = ends(LATIN_ENDS_FEMALE + LATIN_ENDS_MALE + LATIN_ENDS_FAMILY), ends(CYRILLIC_ENDS_FEMALE + CYRILLIC_ENDS_MALE)
    stem = _stem(name, _long_stream(key, "NAME", name, attempt), attempt)
    return _let(stem, lambda x: F.transform(F.when(_is_cyrillic(name), cyrillic).otherwise(latin), lambda e: F.lower(F.concat(x, e))))


# --------------------------------------------------------------------------------------- entities and atoms


def _head(kind: Column, value: Column) -> Column:
    """What stays of a secret or key: its name or prefix."""
    return (
        F.when(kind == "SECRET", F.regexp_extract(value, f"^({_SECRET_HEAD})", 1)).when(kind == "AWS_KEY", F.substring(value, 1, 4))
        .otherwise(F.regexp_extract(value, f"^({_TOKEN_HEAD})", 1))
    )


def _rest(kind: Column, value: Column) -> Column:
    return F.substring(value, F.length(_head(kind, value)) + 1, F.length(value))


def _trunk(value: Column) -> Column:
    """The country code or leading zeros of a telephone number, digits only."""
    return F.regexp_replace(F.regexp_extract(F.translate(value, " ().-", ""), f"^({_COUNTRY}|0+|)", 1), r"\+", "")


def _national(value: Column) -> Column:
    return F.substring(_bare(value), F.length(_trunk(value)) + 1, F.length(value))


def _people(value: Column) -> Column:
    """The names of a person with title, as written; initials among them."""
    return F.split(F.regexp_replace(value, r"^\S+\s", ""), r"\s")


def _is_initials(name: Column) -> Column:
    return name.rlike(f"^{_INITIALS}$")


def _atom(kind: Column | str, value: Column) -> Column:
    return F.concat(F.lit(kind + SEP) if isinstance(kind, str) else F.concat(kind, F.lit(SEP)), value)


def atoms_of(value: Column) -> Column:
    """Array of the atoms of an entity, as type, SEP, value."""

    def of(kind: Column) -> Column:
        names = F.transform(F.filter(_people(value), lambda n: ~_is_initials(n)), lambda n: _atom("NAME", F.lower(n)))
        tail = F.array(F.concat(kind, F.lit(SEP), _rest(kind, value)))
        return (
            F.when(kind == "EMAIL", F.array(_atom("DOMAIN", F.lower(F.substring_index(value, "@", -1))), _atom("MAILBOX", F.lower(value))))
            .when(kind.isin("SECRET", "AWS_KEY", "TOKEN"), tail)
            .when(kind == "IPV6", F.array(_atom("IPV6", F.lower(value))))
            .when(kind == "PHONE", F.array(_atom("PHONE", _national(value))))
            .when(kind == "PERSON", names)
            .when(kind == "IP", F.array(_atom("IP", value)))
            .otherwise(F.array(F.concat(kind, F.lit(SEP), _bare(value))))
        )

    return _let(entity_type(value), of)


def claims_of(kind: Column, value: Column, key: Key, attempt: Column) -> Column:
    """Array of what the surrogate of an atom may read, which no other atom may have."""
    one = (
        F.when(kind == "MAILBOX", F.concat(_mailbox(F.substring_index(value, "@", 1), value, key, attempt), F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "DOMAIN", _domain(value, value, key, attempt)).when(kind == "IP", _ip(value, key, attempt)).when(kind == "IPV6", _ipv6(value, key, attempt))
        .when(kind == "CARD", _card(value, key, attempt)).when(kind == "IBAN", _iban(value, key, attempt))
        .when(kind.isin("SECRET", "AWS_KEY", "TOKEN"), _tail(kind, value, key, attempt)).otherwise(_digits(kind, value, key, attempt))
    )
    return F.when(kind == "NAME", _name_forms(value, key, attempt)).otherwise(F.array(one))


Lookup = Callable[[Column], Column]


def surrogate(value: Column, key: Key, attempt: Lookup = lambda _: F.lit(0)) -> Column:
    """The replacement of one entity; ``attempt`` gives the attempt of an atom."""
    return _let(entity_type(value), lambda kind: _surrogate_of(kind, value, key, attempt))


def _surrogate_of(kind: Column, value: Column, key: Key, attempt: Lookup) -> Column:
    def by(name: Column | str, atom: Column, body) -> Column:
        return _let(atom, lambda v: _let(attempt(_atom(name, v)), lambda a: body(v, a)))

    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    mailbox = by("MAILBOX", F.lower(value), lambda v, a: _mailbox(local, v, key, a))
    email = F.concat(mailbox, F.lit("@"), by("DOMAIN", F.lower(domain), lambda v, a: _domain(domain, v, key, a)))
    ipv6 = by("IPV6", F.lower(value), lambda v, a: _ipv6(v, key, a))
    phone = F.concat(_trunk(value), by("PHONE", _national(value), lambda v, a: _digits("PHONE", v, key, a)))
    number = by(kind, _bare(value), lambda v, a: F.when(kind == "CARD", _card(v, key, a)).when(kind == "IBAN", _iban(v, key, a)).otherwise(_digits(kind, v, key, a)))
    return (
        F.when(kind == "EMAIL", email).when(kind == "PERSON", _person(value, key, attempt))
        .when(kind.isin("SECRET", "AWS_KEY", "TOKEN"), F.concat(_head(kind, value), by(kind, _rest(kind, value), lambda v, a: _tail(kind, v, key, a))))
        .when(kind == "IPV6", F.when(value.rlike("[A-F]"), F.upper(ipv6)).otherwise(ipv6))
        .when(kind == "IP", by("IP", value, lambda v, a: _ip(v, key, a)))
        .otherwise(_let(F.when(kind == "PHONE", phone).otherwise(number), lambda made: _lay(value, made)))
    )


def _is_female(value: Column) -> Column:
    """By the title; an open title leaves it to the ending of the first name."""
    by_title = F.when(value.rlike("^(?:" + "|".join(TITLES_FEMALE) + r")\.?\s"), True).when(value.rlike("^(?:" + "|".join(TITLES_MALE) + r")\.?\s"), False)
    first = F.regexp_extract(value, r"^\S+\s(\S+)", 1)
    return F.coalesce(by_title, first.rlike("(?:a|e|а|я)$"))


def _person(value: Column, key: Key, attempt: Lookup) -> Column:
    """Title and spacing stay, initials turn by the key; each name is replaced by itself, so a person who is also named
    by the last name alone keeps it."""
    title = F.regexp_extract(value, r"^(\S+\s)", 1)
    turned = lambda name: F.translate(name, _UPPER + _CYRILLIC_UPPER, key.rotation(_UPPER) + key.rotation(_CYRILLIC_UPPER))
    one = lambda name, given, female: _let(F.lower(name), lambda low: _let(attempt(_atom("NAME", low)), lambda a: _name(low, given, female, key, a)))
    made = lambda all_, female: F.transform(
        all_, lambda name, i: F.when(_is_initials(name), turned(name)).otherwise(one(name, i < F.size(all_) - 1, female)))
    return F.concat(title, _let(_is_female(value), lambda female: _let(_people(value), lambda all_: F.array_join(made(all_, female), " "))))


def _is_real(value: Column) -> Column:
    """Numbers must be valid to count as a card (of a payment network, by the first digit) or an IBAN."""
    card, iban = PATTERN["CARD"], PATTERN["IBAN"]
    bad_card = value.rlike(f"^(?:{card})$") & (~value.rlike("^[2-6]") | (F.pmod(_luhn_sum(_ints(_bare(value))), F.lit(10)) != 0))
    bad_iban = value.rlike(f"^(?:{iban})$") & (_mod97(_iban_rest(_bare(value))) != 1)
    return ~bad_card & ~bad_iban



def _matches(text: Column) -> Column:
    """What the pattern finds, in order; empty for null."""
    found = F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1))
    maybe = text.rlike(SIGNS)
    for word in WORDS:
        maybe = maybe | F.contains(text, F.lit(word))
    return F.when(maybe, found).otherwise(F.array().cast("array<string>"))


def entities_of(text: Column) -> Column:
    """Array of the entities of a text, in order; empty for null."""
    return F.filter(_matches(text), _is_real)


# --------------------------------------------------------------------------------------------- the corpus


def _split_atom(atom: Column) -> list[Column]:
    return [F.substring_index(atom, SEP, 1).alias("kind"), F.substring(atom, F.instr(atom, SEP) + 1, F.length(atom)).alias("value")]


def made_anew(atoms: DataFrame, key: Key, max_rounds: int = 60) -> DataFrame:
    """(atom, attempt) of the distinct ``atoms`` (column atom) whose first surrogate collides, with the attempt that
    does not.

    Of atoms that claim the same surrogate the one of the lowest attempt, then the smallest, has it. A surrogate may not
    read like a real atom either (a mailbox only unlike itself, since its domain changes). Settled atoms
    keep their surrogates, so a round reads only what is still open against them. As surrogates grow with the
    attempts, rounds end; ``max_rounds`` guards against a fault.
    """
    real = written(atoms.select("atom").distinct(), "atoms")
    todo, settled, late = real.withColumn("attempt", F.lit(0)), None, None
    for _ in range(max_rounds):
        kind, value = _split_atom(F.col("atom"))
        claims = F.transform(F.array_distinct(claims_of(kind, value, key, F.col("attempt"))), lambda c: F.concat(kind, F.lit(SEP), c))
        claimed = written(todo.select("atom", "attempt", F.explode(claims).alias("claim")), "claims")
        owners = claimed.groupBy("claim").agg(F.min("atom").alias("owner"), F.count("*").alias("n")).where("n > 1")
        lost = claimed.join(owners, "claim").where("atom <> owner").select("atom", "attempt")
        taken = claimed.join(real.select(F.col("atom").alias("claim")), "claim").where(~F.col("claim").startswith("MAILBOX") | (F.col("claim") == F.col("atom")))
        lost = lost.unionByName(taken.select("atom", "attempt"))
        if settled is not None:
            lost = lost.unionByName(settled.join(claimed.select("claim", "atom", "attempt"), "claim").select("atom", "attempt"))
        again = written(lost.distinct(), "collisions")
        kept = claimed.join(again.select("atom"), "atom", "left_anti")
        done = kept.where("attempt > 0").select("atom", "attempt").distinct()
        late = done if late is None else late.unionByName(done)
        if again.isEmpty():
            return late
        settled = kept.select("claim") if settled is None else settled.unionByName(kept.select("claim"))
        todo = again.select("atom", (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {max_rounds} attempts")


def _replaced(text: Column, found: Column, made: Column) -> Column:
    """The text with each of ``found`` replaced by its counterpart in ``made``."""
    gaps = F.split(text, ENTITY, -1)
    both = F.zip_with(F.slice(gaps, F.lit(2), F.size(found)), made, lambda gap, m: F.concat(m, gap))
    return F.concat(F.element_at(gaps, 1), F.array_join(both, ""))


def with_surrogates(docs: DataFrame, key: Key, text_col: str = "text", count_as: str | None = None) -> DataFrame:
    """``docs`` with every entity of the text replaced; other columns stay, whatever their names.

    ``count_as``: name for a further column with the number of entities. Null texts stay null, empty
    ones empty; texts are read whole; repeated rows are treated alike; an empty table stays empty.
    The atoms of each text are written once; the attempts of those made anew are joined to the texts that have them
    by a hash of the text, at any size (two texts of one hash would only see each other's attempts as well).
    """
    by, at, found = fresh(docs, "texthash"), fresh(docs, "attempts"), fresh(docs, "found")
    text = col_of(text_col)
    atoms = F.array_distinct(F.flatten(F.transform(entities_of(text), atoms_of)))
    per_text = written(docs.select(F.xxhash64(text).alias("by"), F.explode(atoms).alias("atom")).distinct(), "text-atoms")
    late = written(made_anew(per_text, key), "anew")
    maps = per_text.join(late, "atom").groupBy("by").agg(F.map_from_entries(F.collect_list(F.struct("atom", "attempt"))).alias(at))
    rows = docs.withColumn(found, _matches(text)).withColumn(by, F.xxhash64(text))
    rows = rows.join(written(maps, "attempts").withColumnRenamed("by", by), by, "left")
    passed = F.coalesce(F.col(at), F.create_map().cast("map<string,int>"))
    attempt = lambda atom: F.coalesce(F.element_at(passed, atom), F.lit(0))
    made = F.transform(F.col(found), lambda v: F.when(_is_real(v), surrogate(v, key, attempt)).otherwise(v))
    new = F.when(F.size(found) > 0, _replaced(text, F.col(found), made)).otherwise(text)
    names = [new.alias(c) if c == text_col else col_of(c) for c in docs.columns]
    return rows.select(*names, *([F.size(F.filter(found, _is_real)).alias(count_as)] if count_as else []))
