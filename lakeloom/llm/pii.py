"""Personal data replaced by format-preserving pseudonyms, with SQL functions only.

Found and validated: payment cards (Luhn), dates (calendar), IPv4 addresses, US social-security numbers, phone
numbers, e-mail addresses. A number or date is taken as a pair of mixed-radix digits in exactly its set of valid
values and permuted by a keyed Feistel network with modular addition, so the result has the same format, is valid
again, and equal values get equal pseudonyms in every document. Mail addresses, which are no numbers, keep their
domain and get a keyed local part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
DEMO_KEY = "demonstration key, replace it"
#: Dates from this day on, DATE_A x DATE_B days, are permuted among themselves.
FIRST_DAY, DATE_A, DATE_B = "1900-01-01", 250, 292
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<!\d)\d{2}([./])\d{2}\1\d{4}(?!\d)"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\d-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d|-\d)"
PATTERN = "|".join((EMAIL, DATE, IP, SSN, PHONE, CARD))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(a: str, b: str, p: str, q: str, tweak: str, key: str) -> str:
    """SQL of struct(a, b): the pair (a < p, b < q) permuted within p x q values. In turn, each half gets a keyed hash of the other added, modulo its size."""

    def mixed(i: str, half: str, size: str) -> str:
        return f"pmod(cast(conv(substr(sha2(concat_ws('|', {_text(key)}, '{tweak}', cast({i} as string), cast({half} as string)), 256), 1, 13), 16, 10) as bigint), {size})"

    return f"""aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(i % 2 = 0,
        named_struct('a', pmod(s.a + {mixed("i", "s.b", f"cast({p} as bigint)")}, cast({p} as bigint)), 'b', s.b),
        named_struct('a', s.a, 'b', pmod(s.b + {mixed("i", "s.a", f"cast({q} as bigint)")}, cast({q} as bigint)))))"""


def _with(expr: str, name: str, body: str) -> str:
    """body with ``name`` bound to expr, which is computed once."""
    return f"element_at(transform(array({expr}), {name} -> {body}), 1)"


def _power(n: str) -> str:
    return f"cast(rpad('1', {n} + 1, '0') as bigint)"


def _digits(d: str, tweak: str, key: str) -> str:
    """A string of 2 to 19 digits, permuted among those of its length."""
    half, rest = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
    pair = feistel(f"substr({d}, 1, {half})", f"substr({d}, {half} + 1)", _power(half), _power(rest), tweak, key)
    return _with(pair, "pair", f"concat(lpad(cast(pair.a as string), {half}, '0'), lpad(cast(pair.b as string), {rest}, '0'))")


def _luhn(d: str, first: int) -> str:
    """Luhn sum of a digit string; first: 1 if its last digit is doubled, else 0."""
    digit = f"cast(substr({d}, length({d}) + 1 - i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = {first}, {digit} * 2 - if({digit} > 4, 9, 0), {digit}))"


def _fill(template: str, digits: str) -> str:
    """The template with its digits replaced in order; its other characters stay."""
    return f"""aggregate(split({template}, ''), named_struct('o', '', 'k', 1), (s, c) -> if(c rlike '^[0-9]$',
        named_struct('o', concat(s.o, substr({digits}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"""


def pseudonym(m: str, key: str) -> str:
    """SQL: a match -> its pseudonym, or the match itself if it isn't valid."""
    d = f"regexp_replace({m}, '[^0-9]', '')"
    card = _with(_digits("substr(d, 1, length(d) - 1)", "card", key), "body", _fill(m, f"concat(body, cast((10 - {_luhn('body', 1)} % 10) % 10 as string))"))
    card = _with(d, "d", f"if(length(d) between 13 and 19 and {_luhn('d', 0)} % 10 = 0, {card}, {m})")

    def date(iso: str, back: str) -> str:
        day = f"datediff(try_cast({iso} as date), date'{FIRST_DAY}')"
        pair = feistel(f"day div {DATE_B}", f"day % {DATE_B}", str(DATE_A), str(DATE_B), "date", key)
        made = _with(pair, "pair", f"date_format(date_add(date'{FIRST_DAY}', cast(pair.a * {DATE_B} + pair.b as int)), {back})")
        return _with(day, "day", f"if(day between 0 and {DATE_A * DATE_B - 1}, {made}, {m})")

    year, one, two = f"substr({m}, 7, 4)", f"substr({m}, 1, 2)", f"substr({m}, 4, 2)"
    day_first = f"(substr({m}, 3, 1) = '.' or {one} > '12')"
    european = date(f"concat_ws('-', {year}, {two}, {one})", f"if(substr({m}, 3, 1) = '.', 'dd.MM.yyyy', 'dd/MM/yyyy')")
    american = date(f"concat_ws('-', {year}, {one}, {two})", "'MM/dd/yyyy'")
    octet = [f"cast(split({m}, '[.]')[{i}] as int)" for i in range(4)]
    pair = feistel(f"{octet[0]} * 256 + {octet[1]}", f"{octet[2]} * 256 + {octet[3]}", "65536", "65536", "ip", key)
    ip = f"if(greatest({', '.join(octet)}) <= 255, {_with(pair, 'pair', "concat_ws('.', pair.a div 256, pair.a % 256, pair.b div 256, pair.b % 256)")}, {m})"
    # social-security areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999
    area, group, serial = f"cast(substr({m}, 1, 3) as int)", f"cast(substr({m}, 5, 2) as int)", f"cast(substr({m}, 8, 4) as int)"
    pair = feistel(f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", str(898 * 99), "9999", "ssn", key)
    made = _with(pair, "pair", "concat_ws('-', lpad(cast(pair.a div 99 + if(pair.a div 99 >= 665, 2, 1) as string), 3, '0'), lpad(cast(pair.a % 99 + 1 as string), 2, '0'), lpad(cast(pair.b + 1 as string), 4, '0'))")
    ssn = f"if({area} between 1 and 899 and {area} != 666 and {group} > 0 and {serial} > 0, {made}, {m})"
    # North American numbers: area and exchange start with 2 to 9
    local = "right(d, 10)"
    pair = feistel(f"cast(substr({local}, 1, 3) as int) - 200", f"cast(substr({local}, 4) as int) - 2000000", "800", "8000000", "phone", key)
    american_phone = _with(pair, "pair", _fill(m, "concat(left(d, length(d) - 10), cast(pair.a + 200 as string), cast(pair.b + 2000000 as string))"))
    other = _with(_digits("substr(d, 3)", "phone", key), "rest", _fill(m, "concat(left(d, 2), rest)"))
    phone = _with(d, "d", f"if({local} rlike '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$' and (length(d) = 10 or (length(d) = 11 and left(d, 1) = '1')), {american_phone}, {other})")
    mail = f"concat('user', substr(sha2(concat_ws('|', {_text(key)}, 'mail', lower({m})), 256), 1, 12), substr({m}, instr({m}, '@')))"
    return f"""case when instr({m}, '@') > 0 then {mail}
        when {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then {date(m, "'yyyy-MM-dd'")}
        when {m} rlike '^[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}$' then if({day_first}, {european}, {american})
        when {m} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then {ip}
        when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn}
        when {m} rlike '^[+(]|^[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}$' then {phone}
        else {card} end"""


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = DEMO_KEY, out: str | None = None, found: str | None = None) -> DataFrame:
    """docs with the text's valid personal data replaced, in place or in a new column ``out``.

    found: a column for the array of struct(value, pseudonym) of all matches; a match that isn't valid keeps its value.
    Null stays null, a text without matches (an empty one too) stays as it is; equal values have equal pseudonyms in all rows.
    Other columns pass through, whatever their names; an empty table gives an empty one. No Python runs: a text is split at the matches and joined again.
    """
    text = F.col(text_col)
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    pairs = F.transform(matches, lambda m: F.struct(m.alias("value"), m.alias("pseudonym")))
    tmp = common.fresh("pii_found", docs)
    staged = docs.withColumn(tmp, pairs).withColumn(tmp, F.expr(f"transform({tmp}, p -> named_struct('value', p.value, 'pseudonym', {pseudonym('p.value', key)}))"))
    staged = staged.withColumn(out or text_col, _joined(text, F.col(tmp)))
    return staged.withColumnRenamed(tmp, found) if found else staged.drop(tmp)


def _joined(text: Column, pairs: Column) -> Column:
    parts = F.split(text, PATTERN, -1)
    new = F.concat(F.transform(pairs, lambda p: p["pseudonym"]), F.array(F.lit("")))
    glued = F.array_join(F.zip_with(parts, new, lambda p, n: F.concat(p, n)), "")
    return F.when(F.size(pairs) > 0, glued).otherwise(text)
