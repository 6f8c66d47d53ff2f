"""Generators of plausible values, by name.

A provider is a function from a seed column to a text column, built from JVM-side expressions,
so generated values need no Python worker and can be recomputed anywhere.  ``register`` adds or
replaces one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import seeded
from . import wordlists as wl

Provider = Callable[[Column], Column]
_REGISTRY: dict[str, Provider] = {}

#: Names under which the sensitive-field types are generated.
TYPE_PROVIDERS = {
    "phone": "phone_number",
    "id": "uuid4",
    "ip": "ipv4",
    "credit_card": "credit_card_number",
    "dob": "date_of_birth",
}


def register(name: str, provider: Provider) -> None:
    _REGISTRY[name] = provider


def provider(name: str) -> Provider | None:
    return _REGISTRY.get(TYPE_PROVIDERS.get(name, name))


def provider_names() -> list[str]:
    return sorted(_REGISTRY)


def choice(values: Sequence[str], salt: str = "") -> Provider:
    table = tuple(values)
    return lambda base: seeded.pick(
        F.array(*[F.lit(v) for v in table]), seeded.extend(base, salt) if salt else base)


def number_between(low: int, high: int, salt: str = "", width: int = 0) -> Provider:
    def make(base: Column) -> Column:
        drawn = seeded.below(seeded.extend(base, salt) if salt else base, high - low + 1) + low
        return F.lpad(drawn.cast("string"), width, "0") if width else drawn.cast("string")

    return make


def pattern(shape: str, salt: str = "p") -> Provider:
    """``#`` runs become digits, ``^`` runs hex digits, ``?`` letters; other text stays."""

    def letter(base: Column) -> Column:
        return F.char(seeded.below(base, 26) + 97)

    def make(base: Column) -> Column:
        parts = []
        for i, piece in enumerate(re.findall(r"#{1,12}|\^{1,32}|\?|[^#^?]+", shape)):
            draw = seeded.extend(base, salt, i)
            if piece[0] == "#":
                parts.append(seeded.digits(draw, len(piece)))
            elif piece[0] == "^":
                parts.append(F.substring(F.md5(draw), 1, len(piece)))
            elif piece[0] == "?":
                parts.append(letter(draw))
            else:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    return make


def joined(*parts: str | Provider) -> Provider:
    """Fixed text and providers side by side."""
    return lambda base: F.concat(*[F.lit(p) if isinstance(p, str) else p(base) for p in parts])


def lower(inner: Provider) -> Provider:
    return lambda base: F.lower(inner(base))


def day_between(first: str, days: int, shape: str = "yyyy-MM-dd", salt: str = "day") -> Provider:
    return lambda base: F.date_format(
        F.date_add(F.lit(first).cast("date"), seeded.below(seeded.extend(base, salt), days).cast("int")), shape)


def uuid4(base: Column) -> Column:
    h = F.md5(base)
    variant = F.substring(F.lit("89ab"), (seeded.number(seeded.extend(base, "variant")) % 4).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("4"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def words(low: int, high: int, salt: str = "w") -> Provider:
    def make(base: Column) -> Column:
        lexicon = F.array(*[F.lit(w) for w in wl.FILLER_WORDS])
        n = (seeded.below(seeded.extend(base, salt, "n"), high - low + 1) + low).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: seeded.pick(
            lexicon, seeded.extend(base, salt, i))), " ")

    return make


def sentence(low: int = 4, high: int = 9, salt: str = "s") -> Provider:
    inner = words(low, high, salt)

    def make(base: Column) -> Column:
        body = inner(base)
        return F.concat(F.upper(F.substring(body, 1, 1)), F.substr(body, F.lit(2)), F.lit("."))

    return make


def _luhn_card(base: Column) -> Column:
    """Sixteen digits with a valid check digit."""
    body = F.concat(F.lit("4"), seeded.digits(seeded.extend(base, "a"), 7), seeded.digits(seeded.extend(base, "b"), 7))

    def value(i: Column) -> Column:
        digit = F.substring(body, i, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda acc, i: acc + value(i))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


_first_f, _first_m = choice(wl.FIRST_NAMES_FEMALE, "first"), choice(wl.FIRST_NAMES_MALE, "first")
_first = choice(wl.FIRST_NAMES_FEMALE + wl.FIRST_NAMES_MALE, "first")
_last = choice(wl.LAST_NAMES, "last")
_word = choice(wl.FILLER_WORDS, "word")
_domain = joined(lower(_last), ".", choice(wl.TLDS, "tld"))
_street = joined(choice(wl.STREETS, "street"), " ", choice(wl.STREET_SUFFIXES, "suffix"))
_street_address = joined(pattern("###", "house"), " ", _street)
_octet = [number_between(0, 255, f"octet{i}") for i in range(4)]
_user = joined(lower(_first), ".", lower(_last), pattern("##", "user"))
_clock = joined(number_between(0, 23, "h", 2), ":", number_between(0, 59, "m", 2), ":", number_between(0, 59, "s", 2))
_this_decade = ("2020-01-01", 3653)
_paragraph = joined(sentence(salt="s1"), " ", sentence(salt="s2"), " ", sentence(salt="s3"))

for _name, _provider in {
    "address": joined(_street_address, ", ", choice(wl.CITIES, "city"), ", ",
                      choice(wl.STATE_ABBREVIATIONS, "state"), " ", pattern("#####", "zip")),
    "am_pm": choice(("AM", "PM")),
    "boolean": choice(("True", "False")),
    "building_number": pattern("###"),
    "century": choice(("XVII", "XVIII", "XIX", "XX", "XXI")),
    "city": choice(wl.CITIES, "city"),
    "color_name": choice(wl.COLORS),
    "company": joined(_last, " ", choice(wl.COMPANY_SUFFIXES, "suffix")),
    "company_email": joined(lower(_first), "@", _domain),
    "company_suffix": choice(wl.COMPANY_SUFFIXES),
    "country": choice(wl.COUNTRIES),
    "country_code": choice(wl.COUNTRY_CODES),
    "credit_card_expire": joined(number_between(1, 12, "month", 2), "/", number_between(27, 36, "year")),
    "credit_card_number": _luhn_card,
    "credit_card_provider": choice(wl.CARD_PROVIDERS),
    "credit_card_security_code": pattern("###"),
    "currency_code": choice(wl.CURRENCY_CODES),
    "currency_name": choice(wl.CURRENCY_NAMES),
    "date": day_between("1970-01-01", 20000),
    "date_of_birth": day_between("1940-01-01", 25000),
    "date_time": joined(day_between("1970-01-01", 20000), " ", _clock),
    "date_time_this_decade": joined(day_between(*_this_decade), " ", _clock),
    "day_of_month": number_between(1, 28, width=2),
    "day_of_week": choice(wl.WEEKDAYS),
    "domain_name": _domain,
    "domain_word": lower(_last),
    "ean13": pattern("#############"),
    "ean8": pattern("########"),
    "email": joined(_user, "@", choice(wl.MAIL_DOMAINS, "domain")),
    "file_extension": choice(wl.FILE_EXTENSIONS, "ext"),
    "file_name": joined(_word, ".", choice(wl.FILE_EXTENSIONS, "ext")),
    "file_path": joined("/", choice(wl.FILLER_WORDS, "dir"), "/", _word, ".", choice(wl.FILE_EXTENSIONS, "ext")),
    "first_name": _first,
    "first_name_female": _first_f,
    "first_name_male": _first_m,
    "free_email": joined(_user, "@", choice(wl.MAIL_DOMAINS, "domain")),
    "hex_color": lambda base: F.concat(F.lit("#"), F.substring(F.md5(base), 1, 6)),
    "hostname": joined("host-", pattern("##", "host"), ".", _domain),
    "http_method": choice(wl.HTTP_METHODS),
    "iban": pattern("GB## EXMP ############"),
    "ipv4": joined(_octet[0], ".", _octet[1], ".", _octet[2], ".", _octet[3]),
    "ipv6": pattern("^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^"),
    "isbn10": pattern("#-####-####-#"),
    "isbn13": pattern("978-#-####-####-#"),
    "iso8601": joined(day_between(*_this_decade), "T", _clock),
    "job": choice(wl.JOBS),
    "language_code": choice(wl.LANGUAGE_CODES),
    "last_name": _last,
    "latitude": joined(number_between(-89, 89, "lat"), ".", pattern("######", "fraction")),
    "license_plate": joined(pattern("???", "plate"), pattern("-####", "plate2")),
    "longitude": joined(number_between(-179, 179, "lon"), ".", pattern("######", "fraction")),
    "mac_address": pattern("^^:^^:^^:^^:^^:^^"),
    "md5": lambda base: F.md5(base),
    "mime_type": choice(wl.MIME_TYPES),
    "month": number_between(1, 12, width=2),
    "month_name": choice(wl.MONTHS),
    "msisdn": pattern("#############"),
    "name": joined(_first, " ", _last),
    "name_female": joined(_first_f, " ", _last),
    "name_male": joined(_first_m, " ", _last),
    "paragraph": _paragraph,
    "password": pattern("^^^^^?##??"),
    "past_date": day_between("2015-01-01", 3652),
    "phone_number": pattern("(###) 555-####"),
    "postcode": pattern("#####"),
    "prefix": choice(wl.PREFIXES_FEMALE + wl.PREFIXES_MALE),
    "prefix_female": choice(wl.PREFIXES_FEMALE),
    "prefix_male": choice(wl.PREFIXES_MALE),
    "pybool": choice(("True", "False")),
    "pyfloat": joined(number_between(-99999, 99999, "whole"), ".", pattern("####", "fraction")),
    "pyint": number_between(0, 9999),
    "pystr": pattern("????????????"),
    "random_digit": number_between(0, 9),
    "random_digit_not_null": number_between(1, 9),
    "random_int": number_between(0, 9999),
    "random_letter": pattern("?"),
    "random_number": number_between(0, 999999999),
    "sentence": sentence(),
    "sha1": lambda base: F.sha1(base),
    "sha256": lambda base: F.sha2(base, 256),
    "ssn": pattern("###-##-####"),
    "state": choice(wl.STATES),
    "state_abbr": choice(wl.STATE_ABBREVIATIONS),
    "street_address": _street_address,
    "street_name": _street,
    "street_suffix": choice(wl.STREET_SUFFIXES),
    "suffix": choice(wl.SUFFIXES),
    "text": _paragraph,
    "time": _clock,
    "timezone": choice(wl.TIMEZONES),
    "tld": choice(wl.TLDS),
    "uri": joined("https://", _domain, "/", _word),
    "url": joined("https://", _domain, "/"),
    "user_name": _user,
    "uuid4": uuid4,
    "word": _word,
    "words": words(3, 3),
    "year": number_between(1970, 2025),
    "zipcode": pattern("#####"),
    "zipcode_plus4": pattern("#####-####"),
}.items():
    register(_name, _provider)
