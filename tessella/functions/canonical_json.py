"""Canonical text of JSON values: keys in order, no blanks, ASCII only, numbers in their shortest form.

Equal to Python's ``json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))``, with built-in
functions alone: the variant parser orders the keys, at any depth, and what it would round or decode for
good (numbers) passes through it as text. Work is linear in the length of the text and stays in its row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_STRING_OR_NUMBER = rf'"({_STRING_BODY})"|({_NUMBER})'
# Runs without anything to convert, in which strings hold no escapes, or single strings and numbers.
_RUN = r'(?:"\|[ !#-\[\]-~]*+"|"(?:0|-?[1-9][0-9]*+)\|"|[^"]++)++'
_TOKEN = rf'{_RUN}|"{_STRING_BODY}"'
# A number that the parser may write in another way than Python, or what looks like one inside a string.
_NOT_SHORT_INTEGER = r'[:\[,](?<![^"\s]:)\s*+-?(?:[0-9]{19}|[0-9]++[.eE])'
# Unicode escapes, runs that stay as they are, and single characters that need an escape.
_PIECE = r"\\u[0-9A-Fa-f]{4}|(?:[ -\[\]-~]|\\[^u])++|[^ -~]"
_SURROGATE = r"\\u[dD][89a-fA-F]"
_PAIR_OR_BACKSLASH = r"\\\\|\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}"
_BEYOND_BMP = r"[\x{10000}-\x{10FFFF}]"
_LAST = "￿"  # sorts behind every other UTF-16 unit
DIGITS = 17  # enough for every double
SAFE_DIGITS = 15  # two numbers of so few digits are never the same double, save for the smallest


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once where an expression reads it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _protected(text: Column) -> Column:
    """Strings become ``"|string"`` and numbers ``"number|"``, so both outlive the parser unchanged."""
    return F.regexp_replace(text, _STRING_OR_NUMBER, '"$2|$1"')


def _in_code_point_order(ordered: Column) -> Column:
    """Keys in order of code points, where characters outside the basic plane make UTF-16 order differ."""
    marked = F.regexp_replace(F.replace(ordered, F.lit(_LAST), F.lit(_LAST + " ")), f"({_BEYOND_BMP})", _LAST + "$1")
    again = F.regexp_replace(F.to_json(F.try_parse_json(marked)), f"{_LAST}({_BEYOND_BMP})", "$1")
    return F.when(ordered.rlike(_BEYOND_BMP), F.replace(again, F.lit(_LAST + " "), F.lit(_LAST))).otherwise(ordered)


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _escaped(string: Column) -> Column:
    """ASCII form of a quoted string that the parser wrote."""

    def piece(p: Column) -> Column:
        def char(code: Column) -> Column:
            above = code - 0x10000
            high = _unit(F.shiftright(above, 10) + 0xD800)
            return F.when(code < 0x10000, _unit(code)).otherwise(F.concat(high, _unit(above % 1024 + 0xDC00)))

        return (
            F.when(p.rlike(r"^\\u"), F.lower(p))
            .when(p.rlike(r"^[ -~]"), p)
            .otherwise(_let(F.ascii(p), char))
        )

    pieces = F.transform(F.regexp_extract_all(string, F.lit(_PIECE), F.lit(0)), piece)
    return F.when(string.rlike(r"[^ -~]|\\u"), F.array_join(pieces, "")).otherwise(string)


def _shown(digits: Column, power: Column) -> Column:
    """Digits without outer zeros, of which the first stands for ``10 ** power``, as Python shows floats."""
    n = F.length(digits)
    head, tail = F.substring(digits, 1, 1), F.substr(digits, F.lit(2))
    shift = F.abs(power)
    exponent = F.concat(
        F.when(power < 0, "e-").otherwise("e+"), F.lpad(shift.cast("string"), F.greatest(F.lit(2), F.length(shift.cast("string"))), F.lit("0"))
    )
    scientific = F.concat(head, F.when(n > 1, F.concat(F.lit("."), tail)).otherwise(""), exponent)
    whole = F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))
    split = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return (
        F.when((power < -4) | (power >= 16), scientific)
        .when(power < 0, small)
        .when(n <= power + 1, whole)
        .otherwise(split)
    )


def _shortest(digits: Column, power: Column, value: Column) -> Column:
    """``(digits, power)`` of the shortest decimal that is the same double; the nearest to these digits if two are.

    Any decimal of ``p`` digits between them and the bounds of their double implies that they,
    cut or raised to ``p`` digits give one, so no others need be tried.
    """

    def at(p: Column) -> Column:
        down = F.substr(digits, F.lit(1), p)
        up = (down.cast("decimal(18,0)") + 1).cast("decimal(18,0)").cast("string")
        unit = F.concat(F.lit("e"), (power - p + 1).cast("string"))
        fits = [F.concat(c, unit).cast("double") == value for c in (down, up)]
        nearer_up = F.substr(digits, p + 1, F.lit(1)) >= "5"
        chosen = F.when(fits[0] & ~(fits[1] & nearer_up), down).when(fits[1], up)
        return _let(
            chosen,
            lambda c: F.struct(F.rtrim(c, F.lit("0")).alias("digits"), (power + F.length(c) - p).alias("power")),
        )

    tried = F.transform(F.sequence(F.lit(1), F.least(F.length(digits), F.lit(DIGITS))), at)
    return F.get(F.filter(tried, lambda t: t["digits"].isNotNull()), F.lit(0))


def _parts(text: Column) -> Column:
    """``(digits, power, value)`` of an unsigned decimal."""
    whole = F.regexp_extract(text, r"^([0-9]+)", 1)
    raw = F.concat(whole, F.regexp_extract(text, r"\.([0-9]+)", 1))
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))

    def split(s: Column) -> Column:
        led = F.ltrim(s["raw"], F.lit("0"))
        power = s["exponent"] + F.length(s["whole"]) - 1 - (F.length(s["raw"]) - F.length(led))
        return F.struct(F.rtrim(led, F.lit("0")).alias("digits"), power.cast("int").alias("power"), s["value"].alias("value"))

    read = F.struct(
        whole.alias("whole"), raw.alias("raw"), exponent.alias("exponent"), text.cast("double").alias("value")
    )
    return _let(read, split)


def _float(text: Column) -> Column:
    """A JSON number with point or exponent, without its sign, as Python shows the double it means."""

    def shown(s: Column) -> Column:
        common = F.abs(s["power"]) < 300
        plain = common & (F.length(s["digits"]) <= SAFE_DIGITS)
        # Digits to shorten: exact ones of whole numbers, else the text's, or where it has more digits than a
        # double and may lie far from it, those of the double.
        whole = s["value"].cast("bigint")
        near = (
            F.when((s["value"] < 2.0**62) & (whole.cast("double") == s["value"]), _parts(whole.cast("string")))
            .when(common & (F.length(s["digits"]) <= DIGITS), s)
            .otherwise(_parts(s["value"].cast("string")))
        )
        best = F.when(plain, F.struct(s["digits"].alias("digits"), s["power"].alias("power"))).otherwise(
            _let(near, lambda n: _shortest(n["digits"], n["power"], n["value"]))
        )
        return (
            F.when(s["value"] == 0, "0.0")
            .when(s["value"] == float("inf"), "Infinity")
            .otherwise(_let(best, lambda b: _shown(b["digits"], b["power"])))
        )

    return _let(_parts(text), shown)


def _number(text: Column) -> Column:
    """Integers keep all digits; only negative zero loses its sign, as an integer has none."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    real = F.concat(sign, _let(F.ltrim(text, F.lit("-")), _float))
    return F.when(text.rlike(r"[.eE]"), real).when(text == "-0", "0").otherwise(text)


def _token(token: Column) -> Column:
    """The token as Python writes it: a string, a number, or a run that only loses its marks."""
    run = F.replace(F.regexp_replace(token, r'"(-?[0-9]+)\|"', "$1"), F.lit('"|'), F.lit('"'))
    string = F.concat(F.lit('"'), _escaped(F.substring(token, 3, 2**31 - 1)))
    number = _number(F.substr(token, F.lit(2), F.length(token) - 3))
    single = token.rlike(rf'^"{_STRING_BODY}"$')
    return F.when(~single, run).when(token.startswith('"|'), string).otherwise(number)


def _plain(text: Column) -> Column:
    """Objects and arrays that the parser writes as Python does: no escapes, all ASCII, integers of 64 bits at most."""
    ascii_only = (F.octet_length(text) == F.length(text)) & ~text.contains("\x7f")
    return F.ltrim(text).rlike(r"^[{\[]") & ascii_only & ~text.contains("\\") & ~text.rlike(_NOT_SHORT_INTEGER)


def _members_without(parsed: Column, keys: Sequence[str]) -> Column:
    members = F.try_variant_get(parsed, "$", "map<string,variant>")
    return F.map_filter(members, lambda key, _: ~key.isin(*keys))


def canonical_json(text: Column, without: Sequence[str] = (), *, parsed: Column | None = None) -> Column:
    """Canonical text of a JSON value; ``without`` drops keys of the outermost object.

    ``parsed`` may give what the variant parser made of the text, where it is known.

    Null where the text is null, no JSON value, has a repeated key (also one written with other
    escapes) or half of a surrogate pair, which no UTF-8 text can hold; with ``without``, also where
    it is no object. Integers of any length stay exact. Numbers too large for a double become
    ``Infinity``. Empty objects and arrays stay as they are. Of several shortest decimals of a double,
    that nearest to the text is taken, as long as the text has at most 17 digits;
    of whole numbers below 2**62 it is the nearest to the double. Nesting and size are bounded by the variant parser alone.
    """
    value = F.try_parse_json(text) if parsed is None else parsed
    simple = F.to_json(_members_without(value, without) if without else value)
    halves = text.rlike(_SURROGATE) & F.regexp_replace(text, _PAIR_OR_BACKSLASH, "").rlike(_SURROGATE)
    kept = F.try_parse_json(F.when(value.isNotNull() & ~halves, _protected(text)))
    ordered = F.to_json(_members_without(kept, [f"|{key}" for key in without]) if without else kept)
    tokens = F.regexp_extract_all(_let(ordered, _in_code_point_order), F.lit(_TOKEN), F.lit(0))
    return F.when(_plain(text), simple).otherwise(F.array_join(F.transform(tokens, _token), ""))
