"""Format-preserving pseudonyms for personal data, in column expressions only.

A value is found by pattern, validated, and read as a row of symbols, each with the number of values it can take:
digits and letters for mail addresses, cards, accounts and phones, octets for network addresses, parts for social
security numbers, and two parts of a day number for dates. An alternating Feistel network with a keyed hash permutes
all rows of symbols of one format, so a pseudonym is valid in the same format, different values stay different and
equal values stay linked across documents, however they are punctuated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# Patterns of the formats, in the order in which they are tried.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Lengths of account numbers by country, registered ones and those in use without.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS MA TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(length: int, countries: str) -> str:
    whole, rest = divmod(length - 4, 4)
    last = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{whole}}}{last}"


# Other countries have the lengths of the standard.
_ACCOUNTS = "|".join(_account(n, c) for n, c in IBAN_COUNTRIES.items())
_OTHER = f"(?!{'|'.join(IBAN_COUNTRIES.values()).replace(' ', '|')})[A-Z]{{2}}"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": rf"(?<![A-Za-z0-9])(?:{_ACCOUNTS}|{_OTHER}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])",
    "dotted_date": r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])",
    "slashed_date": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9]|/[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "nanp": r"(?:(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|(?<![0-9+])(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])",
}
# Cards: one run of digits, or the usual groups, and maybe a short group that belongs to the number or follows it (a
# security code, a day); else any groups. None reaches into a value of another format, other groups into no usual ones.
_GROUPS = "[0-9]{4}(?:S[0-9]{4}){2}S[0-9]{1,4}|[0-9]{4}S[0-9]{6}S[0-9]{4,5}|[0-9]{4}(?:S[0-9]{3}){3}"
CARD = f"(?:[0-9]{{13,19}}|{_GROUPS.replace('S', ' ')}|{_GROUPS.replace('S', '-')})(?![0-9])"
_NEXT = "|".join(KINDS[k] for k in ("ipv4", "iso_date", "dotted_date", "slashed_date", "ssn", "nanp"))
KINDS["card"] = (
    f"(?<![0-9])(?:{CARD}(?:[ -](?!{_NEXT}|{CARD})[0-9]{{1,4}}(?![0-9]))?"
    f"|[0-9](?:[0-9]|[ -](?!{_NEXT}|{CARD})[0-9]){{12,18}}(?![0-9]))"
)
# Country codes by their digits, whatever stands between them: those of one and of two digits, else three.
COUNTRY = r"^\+(?:[17]|2S[07]|3S[0-469]|4S[013-9]|5S[1-8]|6S[0-6]|8S[1246]|9S[0-58]|[0-9]S[0-9]S[0-9])".replace("S", "[ .()-]*")
DATES = {"iso_date": "yyyy-MM-dd", "dotted_date": "dd.MM.yyyy", "slashed_date": "MM/dd/yyyy"}
# A slashed date is read day-first where month-first is no date.
DAY_FIRST = "dd/MM/yyyy"
# Formats but mail addresses begin with one of a few signs; the guards keep the search off all other places.
_GUARDS = {"email": "", "iban": "(?=[A-Z]{2}[0-9])"}
PATTERN = "|".join(f"{_GUARDS.get(k, '(?=[0-9+(])')}(?:{p})" for k, p in KINDS.items())
# 400 Gregorian years are 146,097 days, which is 189 times 773.
FIRST_DAY, DAYS, DAY_PARTS = "1700-01-01", 146097, (189, 773)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _chars(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kind_of(value: Column) -> Column:
    """The first format that the whole of a found value has."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    # A North American number in other groups is the same number.
    return F.when((out == "phone") & _digits(value).rlike("^1[0-9]{10}$"), "nanp").otherwise(out)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right; those with index ``doubled`` modulo 2 are doubled."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))


def _mod97(text: Column) -> Column:
    """An account number, its first four signs moved to the end and letters read as 10 to 35, modulo 97."""
    signs = _chars(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4)))

    def step(rest: Column, sign: Column) -> Column:
        letter = sign.rlike("[A-Z]")
        number = F.when(letter, F.ascii(sign) - 55).otherwise(F.ascii(sign) - 48)
        return (rest * F.when(letter, 100).otherwise(10) + number) % 97

    return F.aggregate(signs, F.lit(0), step)


def _date(value: Column, kind: Column) -> Column:
    """The date of a value; null if it is none or outside of the 400 years that can be permuted."""
    formats = [*DATES.items(), ("slashed_date", DAY_FIRST)]
    day = F.coalesce(*(F.when(kind == k, F.try_to_timestamp(value, F.lit(f)).cast("date")) for k, f in formats))
    return F.when(F.datediff(day, F.lit(FIRST_DAY)).between(0, DAYS - 1), day)


def is_valid(value: Column, kind: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    area, group, serial = (F.substring(digits, a, b).cast("int") for a, b in ((1, 3), (4, 2), (6, 4)))
    tests = {
        "card": n.between(13, 19) & (_luhn_sum(digits, 1) % 10 == 0) & (digits.cast("decimal(19,0)") > 0),
        "iban": _mod97(F.regexp_replace(value, " ", "")) == 1,
        "phone": n.between(8, 15),
        "ssn": area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0),
    }
    out = F.when(kind.isin(*DATES), _date(value, kind).isNotNull())
    for k, test in tests.items():
        out = out.when(kind == k, test)
    return out.otherwise(True)


def _fixed_ends(value: Column, kind: Column) -> tuple[Column, Column]:
    """How many signs at the beginning stay, and the last sign that may change."""
    country = F.length(F.regexp_extract(value, COUNTRY, 0))
    own_country = F.length(F.regexp_extract(value, r"^(?:\+1[ .-]?|1[ .-])", 0))
    before = F.when(kind == "iban", 4).when(kind == "phone", country).when(kind == "nanp", own_country).otherwise(0)
    upto = F.when(kind == "email", F.instr(value, "@") - 1).when(kind == "card", F.length(value) - 1)
    return before, upto.otherwise(F.length(value))


def _may_change(value: Column, kind: Column):
    before, upto = _fixed_ends(value, kind)
    return lambda sign, i: sign.rlike("[A-Za-z0-9]") & (i >= before) & (i < upto)


def _symbol(number: Column, size: int | Column) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.struct(number.cast("bigint").alias("v"), size.cast("bigint").alias("m"))


def symbols(value: Column, kind: Column) -> Column:
    """The value as an array of numbers ``v`` below ``m``."""
    changing = F.filter(_chars(value), _may_change(value, kind))

    def of_sign(sign: Column, i: Column) -> Column:
        letter, digit = F.ascii(F.lower(sign)) - 97, F.ascii(sign) - 48
        leads = (kind == "nanp") & i.isin(0, 3)
        return (
            F.when(sign.rlike("[A-Za-z]"), _symbol(letter, 26))
            # Area codes and exchanges begin with 2 to 9; other leading digits stay among themselves.
            .when(leads & (digit >= 2), _symbol(digit - 2, 8))
            .when(leads, _symbol(digit, 2))
            .otherwise(_symbol(digit, 10))
        )

    octets = F.transform(F.split(value, r"\."), lambda o: _symbol(o, 256))
    area, group, serial = (F.substring(value, a, b).cast("int") for a, b in ((1, 3), (5, 2), (8, 4)))
    person = F.array(
        _symbol(area - F.when(area > 666, 2).otherwise(1), 898), _symbol(group - 1, 99), _symbol(serial - 1, 9999)
    )
    day = F.datediff(_date(value, kind), F.lit(FIRST_DAY))
    parts = F.array(_symbol(F.floor(day / DAY_PARTS[1]), DAY_PARTS[0]), _symbol(day % DAY_PARTS[1], DAY_PARTS[1]))
    return (
        F.when(kind == "ipv4", octets).when(kind == "ssn", person).when(kind.isin(*DATES), parts)
        .otherwise(F.transform(changing, of_sign))
    )


def permuted(row: Column, kind: Column, key: str | Column, rounds: int = ROUNDS) -> Column:
    """The row of symbols after an alternating Feistel network; a permutation for each kind and row of sizes."""
    format_ = F.when(kind.isin(*DATES), "date").otherwise(kind)
    secret = key if isinstance(key, Column) else F.lit(key)

    def mixed(half: Column, other: Column, r: Column) -> Column:
        known = F.array_join(F.transform(other, lambda s: s["v"].cast("string")), ",")

        def shifted(salt: Column) -> Callable[[Column, Column], Column]:
            def shift(s: Column, i: Column) -> Column:
                number = F.conv(F.substring(F.sha2(F.concat_ws("|", salt, i), 256), 1, 12), 16, 10).cast("bigint")
                return _symbol(F.pmod(s["v"] + number, s["m"]), s["m"])

            return shift

        return _let(
            F.concat_ws("|", secret, format_, F.size(row), r, known), lambda salt: F.transform(half, shifted(salt))
        )

    def turn(state: Column, r: Column) -> Column:
        left, right = state["left"], state["right"]
        return F.when(
            r % 2 == 0, F.struct(left.alias("left"), mixed(right, left, r).alias("right"))
        ).otherwise(F.struct(mixed(left, right, r).alias("left"), right.alias("right")))

    half = F.floor(F.size(row) / 2).cast("int")
    start = F.struct(F.slice(row, F.lit(1), half).alias("left"), F.slice(row, half + 1, F.size(row) - half).alias("right"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: F.concat(s["left"], s["right"])
    )


def rendered(value: Column, kind: Column, row: Column) -> Column:
    """The permuted symbols in the format of ``value``, check digits made right."""
    may_change = _may_change(value, kind)

    def text_of(places: Column) -> Column:
        def sign_at(place: Column, i: Column) -> Column:
            s = F.element_at(row, F.size(F.filter(F.slice(places, F.lit(1), i), lambda p: p["free"])) + 1)
            old = place["sign"]
            base = F.when(old.rlike("[A-Z]"), 65).when(old.rlike("[a-z]"), 97).when(s["m"] == 8, 50).otherwise(48)
            return F.when(place["free"], F.char(base + s["v"])).otherwise(old)

        return F.array_join(F.transform(places, sign_at), "")

    def card(text: Column) -> Column:
        digits = _digits(text)
        check = F.pmod(10 - _luhn_sum(F.substring(digits, F.lit(1), F.length(digits) - 1), 0), F.lit(10))
        return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), check.cast("string"))

    def iban(text: Column) -> Column:
        unchecked = F.concat(F.substring(text, 1, 2), F.lit("00"), F.substring(text, F.lit(5), F.length(text)))
        check = F.lpad((98 - _mod97(F.regexp_replace(unchecked, " ", ""))).cast("string"), 2, "0")
        return F.concat(F.substring(text, 1, 2), check, F.substring(text, F.lit(5), F.length(text)))

    places = F.transform(_chars(value), lambda sign, i: F.struct(sign.alias("sign"), may_change(sign, i).alias("free")))
    checked = _let(
        _let(places, text_of), lambda text: F.when(kind == "card", card(text)).when(kind == "iban", iban(text)).otherwise(text)
    )
    number = lambda i: F.element_at(row, i)["v"]
    ip = F.array_join(F.transform(row, lambda s: s["v"].cast("string")), ".")
    area = number(1) + F.when(number(1) >= 665, 2).otherwise(1)
    person = F.format_string("%03d-%02d-%04d", area, number(2) + 1, number(3) + 1)
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (number(1) * DAY_PARTS[1] + number(2)).cast("int"))
    out = F.when(kind == "ipv4", ip).when(kind == "ssn", person)
    for k, f in DATES.items():
        made = F.date_format(day, f)
        if k == "slashed_date":
            # Day-first where the day is no month: the pseudonym is then read back as the date that it is.
            swapped = F.try_to_timestamp(value, F.lit(f)).isNull() & (F.dayofmonth(day) > 12)
            made = F.when(swapped, F.date_format(day, DAY_FIRST)).otherwise(made)
        out = out.when(kind == k, made)
    return out.otherwise(checked)


def _number(value: Column, kind: Column) -> Column:
    """The part of a found value that is replaced: of a card in usual groups with a group behind it, the card."""
    head = F.regexp_extract(value, f"^{CARD}", 0)
    return F.when((kind == "card") & is_valid(head, F.lit("card")), head).otherwise(value)


def pseudonym(value: Column, key: str | Column, rounds: int = ROUNDS) -> Column:
    """``kind`` and ``value`` of a found value: its pseudonym, or null and the value as it is where it isn't valid."""

    def judge(found: Column) -> Column:
        part, kind = found["part"], found["kind"]
        row = _let(symbols(part, kind), lambda s: permuted(s, kind, key, rounds))
        made = _let(row, lambda row: rendered(part, kind, row))
        rest = F.substring(value, F.length(part) + 1, F.length(value))
        made = F.when(kind.isNotNull(), F.concat(made, rest)).otherwise(value)
        return F.struct(kind.alias("kind"), made.alias("value"))

    def checked(found: Column) -> Column:
        part, kind = found["part"], found["kind"]
        return F.struct(F.when(is_valid(part, kind), kind).alias("kind"), part.alias("part"))

    found = _let(kind_of(value), lambda kind: F.struct(kind.alias("kind"), _number(value, kind).alias("part")))
    return _let(_let(found, checked), judge)


def pseudonymise(
    docs: DataFrame,
    key: str | DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: ``id_col``, ``text``, ``n_values``, ``kinds``.

    ``text`` has a pseudonym in place of every valid mail address (the domain stays), card and account number,
    phone number (the country code stays), IPv4 address, US social security number and date from 1700 to 2099
    (month-first between slashes, day-first where that is no date);
    everything else is unchanged. ``n_values`` counts them, ``kinds`` lists their formats, sorted and comma-joined.
    Mail addresses that differ in case only, and numbers that differ in punctuation only, share a pseudonym up to
    these. Null texts stay null with no values. Documents are rewritten one by one, so repeated rows give repeated
    results and an empty table an empty one; other columns are not read.

    Not replaced: national phone numbers without a country code, dates with one-digit parts or month names, IPv6
    addresses, and social security numbers without hyphens; digits alone don't tell these from other numbers.

    ``key`` must be kept secret: whoever has it can undo the permutation. It is a string, or a frame with one row and
    column, such as a table that few may read. Plans, and so event logs and messages, name only that relation, not its
    value.
    """
    if isinstance(key, str):
        key = docs.sparkSession.sql("SELECT k FROM VALUES (:k) AS t(k)", args={"k": key})
    rows = docs.select(
        F.col(id_col), F.col(text_col).cast("string").alias("_text"), key.select(F.col(key.columns[0])).scalar().alias("_key")
    )
    # Every format has a digit or an at sign; most texts have neither.
    may_have = F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0))
    found = rows.withColumn("_found", F.when(F.col("_text").rlike("[0-9@]"), may_have).otherwise(F.array().cast("array<string>")))
    made = found.withColumn("_made", F.transform("_found", lambda v: pseudonym(v, F.col("_key"), rounds)))
    between = F.split("_text", PATTERN, -1)
    joined = F.zip_with(between, "_made", lambda a, b: F.concat(a, F.coalesce(b["value"], F.lit(""))))
    kinds = F.filter("_made.kind", lambda k: k.isNotNull())
    return made.select(
        F.col(id_col),
        F.when(F.size("_found") > 0, F.array_join(joined, "")).otherwise(F.col("_text")).alias("text"),
        F.when(F.size("_found") > 0, F.size(kinds)).otherwise(0).cast("long").alias("n_values"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")).alias("kinds"),
    )
