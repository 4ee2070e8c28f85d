"""Format-preserving pseudonyms for personal data, in SQL expressions only.

One regular expression finds candidates: mail addresses, dates, card numbers, IBANs, social security numbers, IPv4
addresses, telephone numbers, keys and passwords. Candidates that hold a checkable number are validated (check digits,
ranges, the calendar) and otherwise stay. What is left is turned into a list of values with a radix each - a digit has
10, a letter 26, an address byte 256, a day its century's days in two parts, anything that belongs to the format 1 - and
permuted by a keyed alternating Feistel network over the two halves of that list: in each round, each value of one half
is moved, modulo its radix, by a keyed hash of the other half. The result has the same format and is valid again; check
digits are computed anew. Equal values have equal pseudonyms in every document, different ones of a kind have different:
a date whose day is over 12 gets another such day, and one of up to 12 another of those, by permuting on until it does.
So a day has one pseudonym in all formats, and which part comes first stays as clear as it was. Letters outside ASCII, in
mail names, stay as they are, and so do IPv6 addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import has_columns

ROUNDS = 10  # an even number, so that the halves end up in their places

# fixed values: what candidates look like, by kind
EMAIL = r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]++@[A-Za-z0-9\-]{1,63}+(?:\.[A-Za-z0-9\-]{1,63}+){1,8}+"
DATE = r"(?<![0-9A-Za-z/.\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?:(?=T\d{2}:\d{2})|(?![0-9A-Za-z/\-]|\.\d))"
CARD = r"(?<![0-9A-Za-z.\-])(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{4,5})(?![0-9A-Za-z]|[.\-]\d)"
IBAN = r"(?<![0-9A-Za-z])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}[a-z0-9]{11,30})(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z\-])(?:\d{3}-\d{2}-\d{4}|(?<!\d )\d{3} \d{2} \d{4}(?! \d))(?![0-9A-Za-z\-])"
IPV4 = r"(?<![0-9A-Za-z.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z]|\.\d)"
PHONE = r"(?<![0-9A-Za-z+(])(?:\+\d{8,15}|(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4})(?![0-9A-Za-z]|[.\-]\d)"
NAMED = r"(?i:password|passwd|token|secret|api_key)[ ]{0,3}[=:][ ]{0,3}"
SECRET = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]*+|" + NAMED + r"(?:\"[^\"\x00-\x20]{6,}+\"|'[^'\x00-\x20]{6,}+'|[\"']?[A-Za-z0-9_\-]{8,}+)|(?i:password|passwd)[ ]{0,3}[=:][ ]{0,3}[\"']?(?=[!-~]*\d)[A-Za-z0-9_\-!@#$%^&*+?~]{6,}+)"
ANY = "|".join((EMAIL, DATE, CARD, IBAN, SSN, IPV4, PHONE, SECRET))

KINDS = ("email", "date", "card", "iban", "ssn", "ipv4", "phone", "secret")


def _text(s: str) -> str:
    """A SQL string literal that takes its characters as they are."""
    return "r'" + s + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, then: str) -> str:
    """then, in which name stands for value."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _feistel(values: str, radices: str, key: str, tweak: str) -> str:
    """The permuted list; values and radices are array<bigint> of equal length, each value below its radix."""
    moved = (
        "transform(s.l, (v, i) -> pmod(v + cast(conv(substr(sha2(concat_ws('|', "
        f"{_text(key)}, {_text(tweak)}, k, i, array_join(transform(s.r, w -> cast(w as string)), ',')), 256), 1, 14), 16, 10) as bigint), "
        "element_at(if(k % 2 = 1, h.a, h.b), i + 1)))"
    )
    loop = f"aggregate(sequence(1, {ROUNDS}), named_struct('l', h.l, 'r', h.r), (s, k) -> named_struct('l', s.r, 'r', {moved}), s -> concat(s.l, s.r))"
    halves = "named_struct('l', slice(p.v, 1, size(p.v) div 2), 'r', slice(p.v, size(p.v) div 2 + 1, size(p.v)), 'a', slice(p.m, 1, size(p.v) div 2), 'b', slice(p.m, size(p.v) div 2 + 1, size(p.v)))"
    return _let("p", f"named_struct('v', {values}, 'm', {radices})", _let("h", halves, loop))


def _chars(text: str, fixed: str, key: str, tweak: str, first_from_two: str = "false") -> str:
    """text with its letters and digits permuted in their classes, but not those for whose index i (from 0) `fixed` holds; where first_from_two does, digits are 2 to 9. Other characters stay and have no part in it, so that a number with separators is linked to the same without."""
    kind = f"CASE WHEN {fixed} THEN 0 WHEN c BETWEEN '0' AND '9' THEN if({first_from_two}, 8, 10) WHEN c BETWEEN 'a' AND 'z' THEN 26 WHEN c BETWEEN 'A' AND 'Z' THEN 27 ELSE 0 END"
    kinds = f"transform(transform(sequence(1, length(q)), i -> substr(q, i, 1)), (c, i) -> named_struct('c', c, 'k', {kind}))"
    parts = "transform(z, (x, i) -> named_struct('c', x.c, 'k', x.k, 'j', size(filter(slice(z, 1, i + 1), y -> y.k > 0))))"
    moving = "filter(u, x -> x.k > 0)"
    values = f"transform({moving}, x -> cast(CASE x.k WHEN 8 THEN ascii(x.c) - 50 WHEN 10 THEN ascii(x.c) - 48 WHEN 26 THEN ascii(x.c) - 97 ELSE ascii(x.c) - 65 END as bigint))"
    radices = f"transform({moving}, x -> cast(if(x.k = 27, 26, x.k) as bigint))"
    place = "element_at(o, x.j)"
    back = f"array_join(transform(u, x -> CASE x.k WHEN 8 THEN chr({place} + 50) WHEN 10 THEN chr({place} + 48) WHEN 26 THEN chr({place} + 97) WHEN 27 THEN chr({place} + 65) ELSE x.c END), '')"
    moved = _let("z", kinds, _let("u", parts, _let("o", _feistel(values, radices, key, tweak), back)))
    return _let("q", text, f"if(q = '', q, {moved})")


def _luhn(digits: str) -> str:
    """The sum of the check over digits, the last counting once."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 0, cast(c as int), cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0))), 0, (a, x) -> a + x)"


def _card(m: str, key: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    moved = _chars(f"substr({m}, 1, length({m}) - 1)", "i = 0", key, "card")
    check = f"pmod(10 - {_luhn("concat(regexp_replace(n, '[^0-9]', ''), '0')")} % 10, 10)"
    return f"if({_luhn(digits)} % 10 = 0, {_let('n', moved, f'concat(n, cast({check} as string))')}, {m})"


def _iban_rest(s: str) -> str:
    number = "if(c BETWEEN '0' AND '9', ascii(c) - 48, ascii(c) - 55)"
    return f"aggregate(split(concat(substr({s}, 5), substr({s}, 1, 4)), ''), 0, (a, c) -> (a * if(c BETWEEN '0' AND '9', 10, 100) + {number}) % 97)"


def _iban_of(m: str) -> str:
    """The longest part of an IBAN candidate, from its start to a space or its end, that has the right check digits; else all of it."""
    parts = "transform(reverse(sequence(1, size(w))), i -> array_join(slice(w, 1, i), ' '))"
    right = f"filter({parts}, y -> y rlike {_text(f'^(?:{IBAN})$')} AND {_iban_rest("upper(replace(y, ' ', ''))")} = 1)"
    return _let("w", f"split({m}, ' ')", f"coalesce(get({right}, 0), {m})")


def _iban(m: str, key: str) -> str:
    rest = _iban_rest
    plain = f"upper(replace({m}, ' ', ''))"
    body = _chars(f"substr({m}, 5)", "false", key, "iban")
    check = f"lpad(cast(98 - {rest("upper(concat(substr(" + m + ", 1, 2), '00', replace(n, ' ', '')))")} as string), 2, '0')"
    return f"if({rest(plain)} = 1, {_let('n', body, f'concat(substr({m}, 1, 2), {check}, n)')}, {m})"


def _ssn(m: str, key: str) -> str:
    parts = f"transform(split({m}, '[- ]'), x -> cast(x as bigint))"
    values = "array(t[0] - if(t[0] > 666, 2, 1), t[1] - 1, t[2] - 1)"
    out = f"format_string('%03d%s%02d%s%04d', o[0] + if(o[0] >= 665, 2, 1), substr({m}, 4, 1), o[1] + 1, substr({m}, 4, 1), o[2] + 1)"
    moved = _let("o", _feistel(values, "array(898L, 99L, 9999L)", key, "ssn"), out)
    return _let("t", parts, f"if(t[0] BETWEEN 1 AND 899 AND t[0] <> 666 AND t[1] > 0 AND t[2] > 0, {moved}, {m})")


def _ipv4(m: str, key: str) -> str:
    moved = f"array_join(transform({_feistel('t', 'array(256L, 256L, 256L, 256L)', key, 'ipv4')}, x -> cast(x as string)), '.')"
    return _let("t", f"transform(split({m}, '[.]'), x -> cast(x as bigint))", f"if(forall(t, x -> x < 256), {moved}, {m})")


def _phone(m: str, key: str) -> str:
    """Country codes stay. North American numbers keep to their plan: area and exchange codes from 200."""
    national = f"regexp_replace({m}, r'^\\+\\d{{1,3}}(?=[ .(\\-])', '')"
    rest = f"if({national} LIKE '+%', substr({m}, 4), {national})"
    digits = "regexp_replace(q, '[^0-9]', '')"
    planned = f"({digits} rlike '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$')"
    before = "length(regexp_replace(substr(q, 1, i), '[^0-9]', ''))"
    moved = _chars("n", "false", key, "phone", f"{planned} AND {before} IN (0, 3)")
    return _let("n", rest, f"if(length(regexp_replace({m}, '[^0-9]', '')) BETWEEN 8 AND 15, concat(substr({m}, 1, length({m}) - length(n)), {moved}), {m})")


def _date(m: str, key: str) -> str:
    """The day moves within its century; the centuries' days are 92 * 397, or 75 * 487 with a leap day more."""
    parts = f"CASE WHEN {m} LIKE '%-%' THEN split({m}, '-') WHEN {m} LIKE '____/%' THEN split({m}, '/') WHEN {m} LIKE '%.%' THEN reverse(split({m}, '[.]')) WHEN cast(split({m}, '/')[0] as int) <= 12 THEN array(split({m}, '/')[2], split({m}, '/')[0], split({m}, '/')[1]) ELSE reverse(split({m}, '/')) END"
    numbers = f"transform({parts}, x -> cast(x as int))"
    valid = "t[0] > 0 AND t[1] BETWEEN 1 AND 12 AND t[2] BETWEEN 1 AND CASE WHEN t[1] BETWEEN 1 AND 12 AND t[0] > 0 THEN day(last_day(make_date(t[0], t[1], 1))) ELSE 0 END"
    start = "make_date(greatest(1, t[0] div 100 * 100), 1, 1)"
    width = "CASE WHEN t[0] < 100 THEN 157L WHEN t[0] div 100 % 4 = 0 THEN 487L ELSE 397L END"  # years 1 to 99: 36159 days, 157 lots of 230 are 49 short of it
    height = "CASE WHEN t[0] < 100 THEN 230L WHEN t[0] div 100 % 4 = 0 THEN 75L ELSE 92L END"
    index = f"cast(datediff(make_date(t[0], t[1], t[2]), {start}) as bigint)"
    # x is days from the century's start
    moved = lambda x: _let("y", x, _let("o", _feistel("array(y div d.w, y % d.w)", "array(d.h, d.w)", key, "date"), "o[0] * d.w + o[1]"))
    at = lambda x: f"date_add(d.s, cast({x} as int))"
    # on to the next day of its sort in the cycle; 128 steps miss it with a probability under 1e-27
    walked = f"aggregate(sequence(1, 128), {moved('d.i')}, (a, j) -> if((day({at('a')}) > 12) = (t[2] > 12), a, {moved('a')}))"
    day = at(walked)
    shape = (
        f"CASE WHEN {m} LIKE '%-%' THEN date_format(e, 'yyyy-MM-dd') WHEN {m} LIKE '____/%' THEN date_format(e, 'yyyy/MM/dd') WHEN {m} LIKE '%.%' THEN date_format(e, if({m} rlike r'^\\d\\d\\.\\d\\d\\.', 'dd.MM.yyyy', 'd.M.yyyy')) "
        f"WHEN cast(split({m}, '/')[0] as int) <= 12 THEN date_format(e, if({m} rlike r'^\\d\\d/\\d\\d/', 'MM/dd/yyyy', 'M/d/yyyy')) ELSE date_format(e, if({m} rlike r'^\\d\\d/\\d\\d/', 'dd/MM/yyyy', 'd/M/yyyy')) END"
    )
    found = _let("d", f"named_struct('i', {index}, 'w', {width}, 'h', {height}, 's', {start})", f"if(d.i >= d.w * d.h, {m}, {_let('e', day, shape)})")
    return _let("t", numbers, f"if({valid}, {found}, {m})")


def _pieces(text: str, key: str, tweak: str) -> str:
    """text permuted in pieces of 64 characters: a list of values costs the square of its length."""
    return f"array_join(transform(regexp_extract_all({text}, '.{{1,64}}', 0), g -> {_chars('g', 'false', key, tweak)}), '')"


def _secret(m: str, key: str) -> str:
    """Key identifiers and web tokens keep their first letters, named values their names; separators stay and have no part in it."""
    value = f"if({m} LIKE 'eyJ%', substr({m}, 4), regexp_replace({m}, {_text(f'^{NAMED}')}, ''))"
    return f"if({m} LIKE 'AKIA%', concat('AKIA', {_chars(f'substr({m}, 5)', 'false', key, 'key')}), {_let('n', value, f"concat(substr({m}, 1, length({m}) - length(n)), {_pieces('n', key, 'secret')})")})"


def _kind(m: str) -> str:
    whole = lambda p: _text(f"^(?:{p})$")
    tests = zip(KINDS, (EMAIL, DATE, CARD, IBAN, SSN, IPV4, PHONE, SECRET), strict=True)
    return "CASE " + " ".join(f"WHEN {m} rlike {whole(p)} THEN '{k}'" for k, p in tests) + " END"


def pseudonym(kind: str, value: str, key: str) -> str:
    """SQL for the pseudonym of value, a candidate of that kind; value itself if it isn't valid."""
    m = "m0"
    email = f"concat({_pieces(f"substring_index({m}, '@', 1)", key, 'email')}, '@', substring_index({m}, '@', -1))"
    cases = {"email": email, "date": _date(m, key), "card": _card(m, key), "iban": _iban(m, key), "ssn": _ssn(m, key), "ipv4": _ipv4(m, key), "phone": _phone(m, key), "secret": _secret(m, key)}
    return _let(m, value, f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {m} END")


def pseudonymised(text: str, key: str) -> Column:
    """struct<text, found array<struct<kind, value, pseudonym>>> for a text column; found has only what was replaced."""
    hits = f"transform(regexp_extract_all({text}, {_text(ANY)}, 0), m -> named_struct('kind', {_kind('m')}, 'whole', m))"
    cut = f"transform({hits}, f -> named_struct('kind', f.kind, 'whole', f.whole, 'value', if(f.kind = 'iban', {_iban_of('f.whole')}, f.whole)))"
    done = f"transform({cut}, f -> named_struct('kind', f.kind, 'value', f.value, 'pseudonym', {pseudonym('f.kind', 'f.value', key)}, 'after', substr(f.whole, length(f.value) + 1)))"
    gaps = f"split({text}, {_text(ANY)}, -1)"
    joined = "array_join(zip_with(gaps, found, (g, f) -> concat(g, coalesce(concat(f.pseudonym, f.after), ''))), '')"
    kept = "transform(filter(found, f -> f.pseudonym <> f.value), f -> named_struct('kind', f.kind, 'value', f.value, 'pseudonym', f.pseudonym))"
    both = _let("found", done, _let("gaps", gaps, f"named_struct('text', {joined}, 'found', {kept})"))
    return F.expr(f"if({text} rlike {_text(ANY)}, {both}, named_struct('text', {text}, 'found', cast(array() as array<struct<kind: string, value: string, pseudonym: string>>)))")


def pseudonymise(docs: DataFrame, key: str, found: str | None = "pii") -> DataFrame:
    """docs with text replaced and a last column `found`, array<struct<kind, value, pseudonym>> of what was replaced; with found None, docs' own columns only.

    All other columns and rows stay as they are, whatever their names; a column of docs named as `found` is overwritten. A
    null text stays null with an empty list; so does an empty one. Long texts are worked on whole. Repeated rows and null
    ids keep theirs; an empty table gives no rows. Numbers that fail validation are left alone, and a value that the
    permutation maps to itself (one in as many as its format has) isn't in the list.
    """
    has_columns(docs, ["text"])
    done = docs.select(F.struct("*").alias("row"), pseudonymised("text", key).alias("done"))
    columns = [F.col("done.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != found]
    return done.select(*columns, *([F.col("done.found").alias(found)] if found else []))
