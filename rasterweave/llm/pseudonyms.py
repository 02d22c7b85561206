"""Format-preserving pseudonyms for private values, in native expressions only.

One pattern finds candidates in a text; each is validated for its kind. Numbers (payment cards by their check digit,
phone numbers, social security and account numbers, network addresses) and calendar dates are permuted within their
format by a keyed Feistel network: ten rounds over two halves, round function SHA-256 of key, kind, length, round and
half. The permutation of a value depends on nothing else, so equal values stay equal in all documents and unequal
ones unequal; separators stay in place, check digits are computed anew, dates stay dates between 1900 and 2099. A date
is permuted among the dates that are written in its form: with slashes, those that read as month, day, year, or else
those that read as day, month, year only, so that no two strings meet. Mail names, access keys and secrets, which are no
numbers, take keyed digits of the same alphabet and length instead (mail names: twelve).

Whoever has the key can undo the permutation, so there is no key in this file: callers bring theirs, and the queries take
the session's ``spark.rasterweave.pseudonym.key``, or, where that is unset, one drawn for this application alone, whose
pseudonyms link documents within it but not beyond.

A run of digits may hold a card beside other numbers (its date, its security code): where the whole run fails the check
digit, its stretches of whole groups are tried.

Defined cases: null text stays null, empty text empty; a candidate that fails validation stays as it is; text
outside the values is untouched; values may be of any length; repeated rows are treated alike; other columns pass
through ``pseudonymize`` unchanged, whatever their names, as its own are chosen among those that are free; null ids are
kept; an empty table gives an empty one.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm.shared import free_names, named, spread

#: What candidates look like, in order of precedence at one place.
PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+[\"']?",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=\d*+[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "address": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?\d{4}){3,6}(?: ?\d{1,3})?(?![A-Za-z0-9])",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
}
# A whole run of groups of digits, up to one that begins something else; the cards in it are found by their check digit.
_OTHERS = "|".join(PATTERNS[k] for k in ("mail", "hex", "date", "address", "social", "phone"))
PATTERNS["card"] = rf"(?<![\d.,])(?=\d(?:[ -]?\d){{12}})\d++(?![.,]\d)(?:[ -](?!{_OTHERS})\d++(?![.,]\d))*+"
KINDS = tuple(PATTERNS)
#: Texts without any of these hold no candidate.
_HINT = r"[0-9@]|(?i:password|passwd|pwd|token|secret|api_?key)"
ROUNDS = 10

_serial = [0]


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, body) -> str:
    """SQL for ``body(name)`` with ``name`` bound to ``value``, so that it is computed once."""
    _serial[0] += 1
    name = f"v{_serial[0]}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _round(key: str, kind: str, size: str, i: str, half: str) -> str:
    return f"cast(conv(substring(sha2(concat_ws(':', {_sql(key)}, '{kind}', {size}, {i}, {half}), 256), 1, 15), 16, 10) as bigint)"


def _feistel(key: str, kind: str, a: str, b: str, even: str, odd: str, size: str = "''") -> str:
    """SQL for struct(a, b) after the rounds; halves live modulo ``even`` (a) and ``odd`` (b)."""
    _serial[0] += 1
    s, i = f"s{_serial[0]}", f"i{_serial[0]}"
    mixed = f"pmod({s}.a + {_round(key, kind, size, i, f'{s}.b')} % 1000000007, if({i} % 2 = 0, {even}, {odd}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), ({s}, {i}) -> named_struct('a', {s}.b, 'b', {mixed}))"


def _ten(n: str) -> str:
    return f"cast(rpad('1', {n} + 1, '0') as bigint)"


def _permuted_digits(key: str, kind: str, digits: str) -> str:
    """SQL: a string of 2 to 34 digits permuted among the strings of its length (up to 18 at once, then the rest)."""

    def block(d: str) -> str:
        def body(d: str) -> str:
            u, v = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
            # after an even number of rounds the halves are back in place
            out = _feistel(key, kind, f"substring({d}, 1, {u})", f"substring({d}, {u} + 1)", _ten(u), _ten(v), f"length({d})")
            return _let(out, lambda s: f"concat(lpad(cast({s}.a as string), {u}, '0'), lpad(cast({s}.b as string), {v}, '0'))")

        return _let(d, body)

    return _let(digits, lambda d: f"if(length({d}) <= 18, {block(d)}, concat({block(f'substring({d}, 1, 16)')}, if(length({d}) = 17, substring({d}, 17), {block(f'substring({d}, 17)')})))")


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _in_format(m: str, digits: str) -> str:
    """SQL: ``m`` with its digits replaced in turn by those of ``digits``."""
    _serial[0] += 1
    s, c = f"s{_serial[0]}", f"c{_serial[0]}"
    step = f"if({c} rlike '^[0-9]$', named_struct('out', concat({s}.out, substring(d, {s}.k, 1)), 'k', {s}.k + 1), named_struct('out', concat({s}.out, {c}), 'k', {s}.k))"
    return _let(digits, lambda d: f"aggregate(split({m}, ''), named_struct('out', '', 'k', 1), ({s}, {c}) -> {step.replace('substring(d,', f'substring({d},')}, {s} -> {s}.out)")


def _luhn(d: str) -> str:
    """SQL: the check sum of a digit string whose last digit counts once."""
    _serial[0] += 1
    t, i = f"t{_serial[0]}", f"i{_serial[0]}"
    x = f"cast(substring({d}, length({d}) - {i}, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), cast(0 as bigint), ({t}, {i}) -> {t} + if({i} % 2 = 0, {x}, ({x} * 2) div 10 + ({x} * 2) % 10))"


def _card(key: str, m: str) -> str:
    def body(d: str) -> str:
        def finish(p: str) -> str:
            return _let(f"concat({p}, cast((10 - {_luhn(f'concat({p}, \'0\')')} % 10) % 10 as string))", lambda q: _in_format(m, q))

        return f"if({_luhn(d)} % 10 = 0, {_let(_permuted_digits(key, 'card', f'substring({d}, 1, length({d}) - 1)'), finish)}, {m})"

    return _let(_digits(m), body)


#: Digits of a card, and how cards are mostly written: these forms go before others that begin further left.
CARD_DIGITS = (13, 19)
_CARD_FORM = "^[ -]?([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){2}[ -][0-9]{1,4}([ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"


def _cards(run: str) -> str:
    """SQL: a run of groups of digits as an array of (t, k) in turn, k being 'card' for cards and null for the rest.

    The whole run is one card if its check digit is right. Otherwise every stretch of whole groups is tried: at each
    group one of a usual form, else the longest that no card of a usual form begins in.
    """
    low, high = CARD_DIGITS
    passes = lambda d: f"(length({d}) between {low} and {high} and {_luhn(d)} % 10 = 0)"
    rest = "cast(null as string)"

    def search(p: str) -> str:
        text = lambda i, c: f"array_join(slice({p}, {i}, {c}), '')"
        _serial[0] += 1
        i, c, e, x, y = (f"{name}{_serial[0]}" for name in ("i", "c", "e", "x", "y"))
        counts = f"filter(sequence(1, least({high}, size({p}) - {i} + 1)), {c} -> {_let(_digits(text(i, c)), passes)})"
        stretch = _let(counts, lambda n: f"named_struct('usual', array_max(filter({n}, {e} -> {text(i, e)} rlike {_sql(_CARD_FORM)})), 'longest', array_max({n}))")

        def choose(w: str) -> str:
            at = f"{w}[{x} - 1]"
            chosen = f"case when {at}.usual is not null then {at}.usual when not exists(slice({w}, {x} + 1, {at}.longest - 1), {e} -> {e}.usual is not null) then {at}.longest end"
            mark = f"regexp_extract({p}[{x} - 1], '^[ -]?', 0)"
            put = lambda n: f"if({n} is null, array(named_struct('t', {p}[{x} - 1], 'k', {rest})), array(named_struct('t', {mark}, 'k', {rest}), named_struct('t', substring({text(x, n)}, length({mark}) + 1), 'k', 'card')))"
            step = _let(chosen, lambda n: f"named_struct('next', {x} + coalesce({n}, 1), 'out', concat({y}.out, {put(n)}))")
            first = f"named_struct('next', 1, 'out', cast(array() as array<struct<t:string,k:string>>))"  # noqa: F541
            return f"aggregate(sequence(1, size({p})), {first}, ({y}, {x}) -> if({x} < {y}.next, {y}, {step}), {y} -> {y}.out)"

        return _let(f"transform(sequence(1, size({p})), {i} -> {stretch})", choose)

    whole = f"array(named_struct('t', {run}, 'k', 'card'))"
    return f"if({_let(_digits(run), passes)}, {whole}, {_let(f'regexp_extract_all({run}, \'[ -]?[0-9]+\', 0)', search)})"


def _phone(key: str, m: str) -> str:
    country = f"regexp_extract({m}, '^(\\\\+[0-9]{{1,3}})[ .(-]', 1)"
    return _let(country, lambda c: f"concat({c}, {_let(f'substring({m}, length({c}) + 1)', lambda r: _in_format(r, _permuted_digits(key, 'phone', _digits(r))))})")


def _social(key: str, m: str) -> str:
    valid = f"(not {m} rlike '^(000|666|9)|-00-|-0000$')"
    again = lambda d: _permuted_digits(key, "social", d)
    bad = lambda d: f"{d} rlike '^(000|666|9)|^...00|0000$'"
    _serial[0] += 1
    y, i = f"y{_serial[0]}", f"i{_serial[0]}"  # walk the cycle until the number is valid again
    walk = f"aggregate(sequence(1, 40), {again(_digits(m))}, ({y}, {i}) -> if({bad(y)}, {again(y)}, {y}))"
    return f"if({valid}, {_in_format(m, walk)}, {m})"


def _address(key: str, m: str) -> str:
    def body(p: str) -> str:
        part = lambda k: f"cast({p}[{k}] as int)"
        inside = " and ".join(f"{part(k)} <= 255" for k in range(4))
        out = _feistel(key, "address", f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536")
        return f"if({inside}, {_let(out, lambda s: f'concat_ws(\'.\', {s}.a div 256, {s}.a % 256, {s}.b div 256, {s}.b % 256)')}, {m})"

    return _let(f"split({m}, '[.]')", body)


def _account(key: str, m: str) -> str:
    """Account numbers with two check digits (97 less the remainder of the rearranged number by 97)."""

    def remainder(s: str) -> str:
        _serial[0] += 1
        t, c = f"t{_serial[0]}", f"c{_serial[0]}"
        return f"aggregate(split({s}, ''), 0, ({t}, {c}) -> if({c} rlike '^[A-Z]$', ({t} * 100 + ascii({c}) - 55) % 97, if({c} rlike '^[0-9]$', ({t} * 10 + cast({c} as int)) % 97, {t})))"

    def body(s: str) -> str:
        head = f"substring({s}, 1, 2)"
        valid = f"{remainder(f'concat(substring({s}, 5), substring({s}, 1, 4))')} = 1"

        def finish(b: str) -> str:
            check = f"lpad(cast(98 - {remainder(f'concat({b}, {head}, \'00\')')} as string), 2, '0')"
            return _let(f"concat({check}, {b})", lambda d: _in_format(m, d))

        return f"if({valid}, {_let(_permuted_digits(key, 'account', f'substring({s}, 5)'), finish)}, {m})"

    return _let(f"replace({m}, ' ', '')", body)


#: Days from 1900-01-01 to 2099-12-31, the side of the least square that holds them, and most steps of a walk: at
#: least 3 in 5 numbers of the square end one.
_DAYS, _SIDE, _STEPS = 73_049, 271, 100


def _date(key: str, m: str) -> str:
    day = f"coalesce(cast(try_to_timestamp({m}, 'yyyy-MM-dd') as date), cast(try_to_timestamp({m}, 'MM/dd/yyyy') as date), cast(try_to_timestamp({m}, 'dd/MM/yyyy') as date), cast(try_to_timestamp({m}, 'dd.MM.yyyy') as date))"

    def once(y: str) -> str:
        return _let(_feistel(key, "date", f"{y} div {_SIDE}", f"{y} % {_SIDE}", str(_SIDE), str(_SIDE)), lambda s: f"{s}.a * {_SIDE} + {s}.b")

    def body(d: str) -> str:
        _serial[0] += 1
        y, i = f"y{_serial[0]}", f"i{_serial[0]}"
        first = _let(f"cast(datediff({d}, date'1900-01-01') as bigint)", once)
        us = f"try_to_timestamp({m}, 'MM/dd/yyyy') is not null"
        # a date of day, month, year alone has a day beyond the 12th; the walk goes on to the next such day
        fits = f"{y} < {_DAYS} and (day(date_add(date'1900-01-01', cast({y} as int))) > 12 or not {m} like '%/%' or {us})"
        walk = f"aggregate(sequence(1, {_STEPS}), {first}, ({y}, {i}) -> if({fits}, {y}, {once(y)}))"
        form = lambda n: f"case when {m} like '____-%' then date_format({n}, 'yyyy-MM-dd') when {m} like '%.%' then date_format({n}, 'dd.MM.yyyy') when {us} then date_format({n}, 'MM/dd/yyyy') else date_format({n}, 'dd/MM/yyyy') end"
        return f"if({d} between date'1900-01-01' and date'2099-12-31', {_let(f'date_add(date\'1900-01-01\', cast({walk} as int))', form)}, {m})"

    return _let(day, body)


def _keyed(key: str, kind: str, value: str, n: str) -> str:
    """SQL: ``n`` keyed hexadecimal digits for ``value``, in blocks of 64."""
    _serial[0] += 1
    i = f"i{_serial[0]}"
    return f"substring(array_join(transform(sequence(0, ({n} - 1) div 64), {i} -> sha2(concat_ws(':', {_sql(key)}, '{kind}', {i}, {value}), 256)), ''), 1, {n})"


def _mail(key: str, m: str) -> str:
    return f"concat('u', {_keyed(key, 'mail', f'lower({m})', '12')}, substring({m}, instr({m}, '@')))"


def _secret(key: str, m: str) -> str:
    def body(n: str) -> str:
        value = f"regexp_extract(substring({m}, {n} + 1), '^[A-Za-z0-9+/_-]+', 0)"
        return _let(value, lambda v: f"concat(substring({m}, 1, {n}), {_keyed(key, 'secret', v, f'length({v})')}, substring({m}, {n} + length({v}) + 1))")

    return _let(f"length(regexp_extract({m}, '^[^=:]*[=:]\\\\s*[\"\\']?', 0))", body)


def _access(key: str, m: str) -> str:
    return f"concat(substring({m}, 1, 4), upper({_keyed(key, 'secret', m, '16')}))"


def _hex(key: str, m: str) -> str:
    return _keyed(key, "secret", m, f"length({m})")


def kind_of(m: str) -> str:
    """SQL: the kind of a candidate, by the first pattern that matches all of it."""
    # A candidate stands alone here, so what a pattern asks of its surroundings holds.
    cases = " ".join(f"when {m} rlike {_sql('^(?:' + p + ')$')} then '{k}'" for k, p in PATTERNS.items() if k != "card")
    return f"case {cases} when {m} rlike '^[0-9 -]+$' then 'card' end"


def values_of(m: str) -> str:
    """SQL: the candidate ``m`` as an array of (t, k), text and kind (null: stays) in turn."""
    return _let(kind_of(m), lambda k: f"if({k} = 'card', {_cards(m)}, array(named_struct('t', {m}, 'k', {k})))")


def pseudonym(m: str, kind: str, key: str) -> str:
    """SQL: what replaces the value ``m`` of a kind; the value itself if it fails validation."""
    makers = {"mail": _mail, "secret": _secret, "access": _access, "hex": _hex, "date": _date, "address": _address, "account": _account, "social": _social, "phone": _phone, "card": _card}
    return "case " + " ".join(f"when {kind} = '{name}' then {make(key, m)}" for name, make in makers.items()) + f" else {m} end"


def _every() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


#: The setting that names the key, and the keys drawn where it is unset, by application.
KEY_SETTING = "spark.rasterweave.pseudonym.key"
_DRAWN: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The session's key; where none is set, one drawn for the application."""
    return spark.conf.get(KEY_SETTING, None) or _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` replaced, and __found: (kind, value, pseudonym) of each value in turn.

    ``key``: the secret of the permutation, not empty. __found takes more underscores if ``docs`` has that name.
    """
    if not key:
        raise ValueError("a key is needed")
    whole, many, pieces, new, joined, result = free_names(docs.columns, "__text", "__m", "__pieces", "__new", "__joined", "__found")
    text = named(text_col).cast("string")
    found = F.when(text.rlike(_HINT), F.expr(f"regexp_extract_all({whole}, {_sql(_every())}, 0)")).otherwise(F.array().cast("array<string>"))
    some = F.size(many) > 0
    changed = F.expr(f"transform({many}, m -> transform({values_of('m')}, x -> named_struct('kind', x.k, 'value', x.t, 'pseudonym', {pseudonym('x.t', 'x.k', key)})))")
    put = F.expr(f"concat(array_join(zip_with(slice({pieces}, 1, size({new})), {new}, (p, n) -> concat(p, array_join(n.pseudonym, ''))), ''), element_at({pieces}, -1))")
    out = docs.withColumn(whole, text).withColumn(many, found).withColumn(pieces, F.when(some, F.expr(f"split({whole}, {_sql(_every())}, -1)"))).withColumn(new, F.when(some, changed))
    out = out.withColumn(joined, F.when(some, put).otherwise(F.col(whole)))
    kept: list[Column] = [F.col(joined).alias(c) if c == text_col else named(c) for c in docs.columns]
    real = F.filter(F.coalesce(F.flatten(new), F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")), lambda x: x["value"] != x["pseudonym"])
    return out.select(*kept, real.alias(result))


def private_values(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, has_private, n_private, kinds (sorted), text with pseudonyms."""
    out = pseudonymize(spread(docs).select(named(id_col).alias("doc_id"), named(text_col).alias("text")), key)
    return out.select(
        "doc_id", (F.size("__found") > 0).alias("has_private"), F.size("__found").cast("long").alias("n_private"), F.array_join(F.array_sort(F.array_distinct(F.col("__found.kind"))), ",").alias("kinds"), "text"
    )
