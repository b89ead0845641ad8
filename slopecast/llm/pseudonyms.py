"""Format-preserving pseudonyms for personal numbers and dates, with DataFrame functions only.

Values are found by pattern and checked by their own rules. What passes is permuted by a keyed Feistel
network within its format: the pseudonym has the same shape, passes the same check, and is the same
for equal values everywhere, so records stay linked; with the key it can be turned back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Steps of a cycle walk; a step misses the valid range in at most 27 of 100 cases.
WALK = 60

# Characters of an IBAN by country (SWIFT registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """A country's own number of characters, in blocks of four that blanks may part; else, as for countries
    that are not listed, 8 to 31 characters after the check digits, as long as they go on."""

    def body(n: int) -> str:
        rest = f"\\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""
        return rf"\d{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}"

    listed = "|".join(f"(?:{'|'.join(names.split())}){body(n)}" for n, names in IBAN_LENGTHS.items())
    other = r"[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
    return rf"(?:(?:{listed})(?![\p{{L}}\p{{N}}])|{other})(?![\p{{L}}\p{{N}}])"


# Patterns of the kinds, tried in this order at each place.
EDGE = r"(?<![\p{L}\p{N}_.%+@-])"
PATTERNS = {
    "secret": r"""(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)\x20{0,3}[=:]\x20{0,3}["']?[A-Za-z0-9_/+-]{16,}+""",
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "iban": _iban_pattern(),
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?<sep>[/.])\d{1,2}\k<sep>\d{4})(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!-?\d)",
    "phone": r"(?:\+?\d{1,3}[\x20.-]?)?\(\d{2,4}\)[\x20.-]?\d{3,4}[\x20.-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?:\d{4}(?<gap>[\x20-])\d{4}\k<gap>\d{4}\k<gap>\d{4}|\d{4}(?<space>[\x20-])\d{6}\k<space>\d{5}|\d{13,19})(?!\d)",
}
ANY = EDGE + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(digits: str, key: str, label: str, back: bool = False) -> str:
    """SQL for the keyed permutation of a string of two or more digits, same length.

    The halves take turns: (a, b) becomes (b, a + f(round, b)) modulo the size of a; f is taken from
    SHA-256 over key, label, length, round and b. back gives the inverse.
    """
    k = _sql(f"{key}|{label}|")
    f = "cast(conv(substr(sha2(concat({k}, length(x.d), '|', i, '|', {b}), 256), 1, 15), 16, 10) as bigint)"
    size = "cast(rpad('1', 1 + if(i % 2 = 0, shiftright(length(x.d), 1), length(x.d) - shiftright(length(x.d), 1)), '0') as bigint)"
    if back:
        rounds = f"reverse(sequence(0, {ROUNDS - 1}))"
        step = f"named_struct('a', pmod(s.b - {f.format(k=k, b='s.a')}, {size}), 'b', s.a)"
    else:
        rounds = f"sequence(0, {ROUNDS - 1})"
        step = f"named_struct('a', s.b, 'b', pmod(s.a + {f.format(k=k, b='s.b')}, {size}))"
    return (
        f"element_at(transform(array(named_struct('d', {digits})), x -> aggregate({rounds}, "
        "named_struct('a', cast(left(x.d, shiftright(length(x.d), 1)) as bigint), 'b', cast(substr(x.d, shiftright(length(x.d), 1) + 1) as bigint)), "
        f"(s, i) -> {step}, s -> concat(lpad(cast(s.a as string), shiftright(length(x.d), 1), '0'), "
        "lpad(cast(s.b as string), length(x.d) - shiftright(length(x.d), 1), '0')))), 1)"
    )


def walked(digits: str, key: str, label: str, valid: str, back: bool = False) -> str:
    """SQL for the permutation of the digit strings z for which `valid` holds, by cycle walking."""
    step = feistel("y.z", key, label, back)
    ok = valid.replace("{z}", "y.z")
    return (
        f"aggregate(sequence(1, {WALK}), named_struct('z', {digits}, 'n', 0), "
        f"(y, t) -> if(y.n > 0 and {ok}, y, named_struct('z', {step}, 'n', y.n + 1)), y -> y.z)"
    )


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _into(text: str, digits: str) -> str:
    """SQL that puts digits, in order, in place of those of a text."""
    return (
        f"element_at(transform(array(named_struct('t', {text}, 'p', {digits})), q -> array_join(transform(sequence(1, length(q.t)), "
        "j -> if(substr(q.t, j, 1) between '0' and '9', substr(q.p, length(regexp_replace(left(q.t, j), '[^0-9]', '')), 1), substr(q.t, j, 1))), '')), 1)"
    )


def luhn_sum(digits: str) -> str:
    """SQL for the Luhn sum of digits, the last one counted once."""
    at = "(cast(substr(l.d, length(l.d) - j, 1) as int) * (1 + j % 2))"
    return (
        f"element_at(transform(array(named_struct('d', {digits})), l -> aggregate(sequence(0, length(l.d) - 1), 0L, "
        f"(c, j) -> c + {at} div 10 + {at} % 10)), 1)"
    )


def _mod97(text: str) -> str:
    """SQL for the remainder by 97 of an IBAN body, letters counting as 10 to 35."""
    value = "(ascii(substr(m.t, j, 1)) - if(substr(m.t, j, 1) between '0' and '9', 48, 55))"
    return (
        f"element_at(transform(array(named_struct('t', {text})), m -> aggregate(sequence(1, length(m.t)), 0, "
        f"(c, j) -> (c * if({value} > 9, 100, 10) + {value}) % 97)), 1)"
    )


def _ip(key: str, back: bool) -> str:
    """SQL: the 32 bits as a number of ten digits, walked within the 32-bit range."""
    octet = [f"cast(split(v.m, '[.]')[{i}] as bigint)" for i in range(4)]
    number = f"lpad(cast({octet[0]} * 16777216 + {octet[1]} * 65536 + {octet[2]} * 256 + {octet[3]} as string), 10, '0')"
    moved = walked(number, key, "ip", "cast({z} as bigint) < 4294967296", back)
    parts = ", ".join(f"cast(shiftright(g, {s}) & 255 as string)" for s in (24, 16, 8, 0))
    valid = " and ".join(f"{o} < 256" for o in octet)
    return f"if({valid}, element_at(transform(array(cast({moved} as bigint)), g -> concat_ws('.', {parts})), 1), v.m)"


def _date(key: str, back: bool) -> str:
    """SQL: the day number since 1900 walked within the two centuries; the shape is kept.

    With two digits before the year, day and month are read in that order if that is a date, else
    month and day. What is no date of the two centuries stays.
    """
    days = f"lpad(cast(datediff(h.day, date'{FIRST_DAY}') as string), 5, '0')"
    moved = walked(days, key, "date", f"cast({{z}} as int) <= datediff(date'{LAST_DAY}', date'{FIRST_DAY}')", back)
    part = lambda i: f"lpad(split(v.m, '[/.]')[{i}], 2, '0')"
    year = "split(v.m, '[/.]')[2]"
    iso, dmy, mdy = "v.m", f"concat_ws('-', {year}, {part(1)}, {part(0)})", f"concat_ws('-', {year}, {part(0)}, {part(1)})"
    sep = "substr(regexp_replace(v.m, '[0-9]', ''), 1, 1)"
    write = (
        "case h.shape when 'iso' then cast(o as string) "
        f"when 'dmy' then date_format(o, concat('dd', {sep}, 'MM', {sep}, 'yyyy')) else date_format(o, concat('MM', {sep}, 'dd', {sep}, 'yyyy')) end"
    )
    out = f"element_at(transform(array(date_add(date'{FIRST_DAY}', cast({moved} as int))), o -> {write}), 1)"
    shapes = (
        f"case when substr(v.m, 5, 1) = '-' then named_struct('shape', 'iso', 'day', try_cast({iso} as date)) "
        f"when try_cast({dmy} as date) is not null then named_struct('shape', 'dmy', 'day', try_cast({dmy} as date)) "
        f"else named_struct('shape', 'mdy', 'day', try_cast({mdy} as date)) end"
    )
    return f"element_at(transform(array({shapes}), h -> if(h.day between date'{FIRST_DAY}' and date'{LAST_DAY}', {out}, v.m)), 1)"


def _value(kind: str, key: str, back: bool) -> str:
    """SQL for the pseudonym of v.m, a match of the kind; a value that fails its check stays."""
    digits = _digits("v.m")
    if kind == "ip":
        return _ip(key, back)
    if kind == "date":
        return _date(key, back)
    if kind == "ssn":
        valid = "(left({z}, 3) not in ('000', '666') and left({z}, 1) <> '9' and substr({z}, 4, 2) <> '00' and right({z}, 4) <> '0000')"
        return f"if({valid.replace('{z}', digits)}, {_into('v.m', walked(digits, key, 'ssn', valid, back))}, v.m)"
    if kind == "phone":
        code = r"regexp_extract(v.m, '^[+][0-9]{1,3}(?=[^0-9])', 0)"
        own = f"substr(v.m, length({code}) + 1)"
        return f"concat({code}, {_into(own, feistel(_digits(own), key, 'phone', back))})"
    if kind == "card":
        # the last digit is the Luhn check digit of a card; any other long number is permuted whole
        head = f"left({digits}, length({digits}) - 1)"
        body = feistel(head, key, "card", back)
        check = f"element_at(transform(array({body}), w -> concat(w, cast((10 - {luhn_sum('concat(w, 0)')} % 10) % 10 as string))), 1)"
        # a number that is no card must not become one, and must be told from cards when turned back
        other = walked(digits, key, "number", f"{luhn_sum('{z}')} % 10 <> 0", back)
        return f"if({luhn_sum(digits)} % 10 = 0, {_into('v.m', check)}, {_into('v.m', other)})"
    if kind == "iban":
        plain = "regexp_replace(v.m, ' ', '')"
        country, body = f"left({plain}, 2)", f"substr({plain}, 5)"
        ok = f"{_mod97(f'concat({body}, left({plain}, 4))')} = 1 and length({_digits(body)}) between 2 and 30"
        # the body's digits in parts of at most 18, which fit the arithmetic
        first, rest = f"left({_digits(body)}, 18)", f"substr({_digits(body)}, 19)"
        tail = f"if(length({rest}) > 1, {feistel(f'if(length({rest}) > 1, {rest}, {_sql('00')})', key, 'iban2', back)}, {rest})"
        moved = _into(body, f"concat({feistel(first, key, 'iban', back)}, {tail})")
        check = f"element_at(transform(array({moved}), w -> concat({country}, lpad(cast(98 - {_mod97(f'concat(w, {country}, {_sql("00")})')} as string), 2, '0'), w)), 1)"
        spaced = f"element_at(transform(array({check}), w -> if(v.m like '% %', trim(regexp_replace(w, '(.{{4}})', '$1 ')), w)), 1)"
        return f"if({ok}, {spaced}, v.m)"
    if kind == "email":
        return f"concat('user-', left(sha2(concat({_sql(key + '|email|')}, lower(v.m)), 256), 16), '@mail.invalid')"
    head = r"""regexp_extract(v.m, '^[^=:]*[=:] *["\']?', 0)"""
    return f"concat({head}, left(repeat(sha2(concat({_sql(key + '|secret|')}, substr(v.m, length({head}) + 1)), 256), 1 + shiftright(length(v.m), 6)), length(v.m) - length({head})))"


def pseudonymised(column: str, key: str, back: bool = False) -> Column:
    """Struct (text, kinds) of a text column: personal values replaced, and the kind of each in order.

    Kinds: Luhn-checked cards, other numbers of 13 to 19 digits, phone numbers, social security
    numbers, IBANs (mod 97), IPv4 addresses and dates from 1900 to 2099 are permuted within their
    format and keep their check; email addresses and secrets are no numbers and get a keyed digest
    of the same sort (one way). Dates with the year last are day first where that is a date, and get
    two digits for day and month. Numbers that fail a kind's rules stay. Null gives a null text; a
    text without digits, @ or an assignment sign is not searched. back turns the permuted kinds back.
    """
    kind = "case " + " ".join(f"when m rlike {_sql('^(?:' + p + ')$')} then '{k}'" for k, p in PATTERNS.items()) + " end"
    value = "case v.k " + " ".join(f"when '{k}' then {_value(k, key, back)}" for k in PATTERNS) + " else v.m end"
    any_kind = _sql(ANY)
    return F.expr(
        f"element_at(transform(array(named_struct('t', `{column}`)), e -> if(e.t rlike '[0-9@=:]', "
        f"element_at(transform(array(transform(regexp_extract_all(e.t, {any_kind}, 0), m -> named_struct('m', m, 'k', {kind}))), f -> "
        f"named_struct('text', array_join(zip_with(split(e.t, {any_kind}, -1), transform(f, v -> {value}), (a, b) -> concat(a, coalesce(b, ''))), ''), "
        "'kinds', transform(f, v -> v.k))), 1), "
        "named_struct('text', e.t, 'kinds', cast(array() as array<string>)))), 1)"
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text column pseudonymised; rows, other columns and null texts stay. No shuffle."""
    return docs.withColumn(text_col, pseudonymised(text_col, key)["text"])
