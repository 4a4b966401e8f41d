"""Text rules as column expressions: readings, values, replies and recognised sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from netloom.functions import dims

# fixed values: characters accepted besides letters and digits, and unit spellings
_OTHER = r"[^\p{L}\p{N}. +\-]"
_DIGITS_PREFIX = r"^([0-9.]+)"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def compact(c: Column) -> Column:
    """Trimmed, without blanks and newlines; empty when under half the characters are permitted.

    Letters and digits of any script are permitted, so the listed unit letters add nothing.
    """
    t = F.regexp_replace(_strip(c), "[ \n]", "")
    good = F.length(F.regexp_replace(t, _OTHER, ""))
    return F.when(good < F.length(t) * F.lit(0.5), F.lit("")).otherwise(t)


def expand_shorthand(c: Column) -> Column:
    """4R7, 1k2, 3V3, 1A5 and two digits with V up to 50; the first rule that fits wins."""
    def g(p, i):
        return F.regexp_extract(c, p, i)

    ohm, kilo = r"^([0-9]+)[Rr]([0-9]+)(.*)$", r"^([0-9]+)([kKmM])([0-9]+)(Ω?)$"
    volt, amp, two = r"^([0-9]+)[Vv]([0-9]+)$", r"^([0-9]+)[Aa]([0-9]+)$", r"^([0-9]{2})[Vv]$"
    return (F.when(c.rlike(ohm), F.concat(g(ohm, 1), F.lit("."), g(ohm, 2), F.lit("Ω")))
            .when(c.rlike(kilo), F.concat(g(kilo, 1), F.lit("."), g(kilo, 3), g(kilo, 2), F.lit("Ω")))
            .when(c.rlike(volt), F.concat(g(volt, 1), F.lit("."), g(volt, 2), F.lit("V")))
            .when(c.rlike(amp), F.concat(g(amp, 1), F.lit("."), g(amp, 2), F.lit("A")))
            .when(c.rlike(two) & (g(two, 1) <= "50"), F.concat(tenth(g(two, 1)), F.lit("V")))
            .otherwise(c))


def tenth(two_digits: Column) -> Column:
    """Two digits divided by ten with one decimal: 33 -> 3.3, 05 -> 0.5."""
    return F.concat(F.substring(two_digits, 1, 1), F.lit("."), F.substring(two_digits, 2, 1))


def single_dots(c: Column) -> Column:
    return F.replace(c, F.lit(".."), F.lit("."))


def clean_reading(c: Column) -> Column:
    """Reading as stored: compact, expanded, doubled dots mended."""
    return single_dots(expand_shorthand(compact(c)))


def variants(c: Column) -> Column:
    """Ordered other interpretations of a reading as ARRAY<STRUCT<value, hint>>."""
    num = F.regexp_extract(c, _DIGITS_PREFIX, 1)

    def v(cond, value, hint):
        pair = F.struct(value.alias("value"), F.lit(hint).alias("hint"))
        return pair if cond is None else F.when(cond, pair)

    k, volt = c.rlike(r"^[0-9.]+[Hz]$"), c.rlike(r"^[0-9.]+V$")
    two = r"^([0-9]{2})([kKmMμ])"
    items = [v(None, c, ""),
             v(k, F.concat(num, F.lit("kΩ")), "Ω"), v(k, F.concat(num, F.lit("MΩ")), "Ω"),
             v(k, F.concat(num, F.lit("Ω")), "Ω"),
             v(volt, F.concat(num, F.lit("Ω")), "Ω"), v(volt, F.concat(num, F.lit("μF")), "F"),
             v(volt, F.concat(num, F.lit("F")), "F"),
             v(c.rlike(two), F.concat(tenth(F.regexp_extract(c, two, 1)), F.regexp_extract(c, two, 2)), ""),
             v(c.rlike("[kKmM]$"), F.concat(c, F.lit("Ω")), "Ω")]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _pick(name: Column, cases: dict, otherwise) -> Column:
    out = None
    for key, value in cases.items():
        out = F.when(name == key, value) if out is None else out.when(name == key, value)
    return out.otherwise(otherwise)


def fits(value: Column, name: Column) -> Column:
    """Corrected value when it suits the component type, else NULL (wiring order of checks).

    Types without a pattern take any text; that comes before all exclusions.
    """
    patterns = dims.VALUE_PATTERNS["wiring"]
    has_unit = value.rlike(dims.UNIT_END)
    unit = _pick(name, {n: F.lit(u) for n, (_, u) in patterns.items()}, F.lit(""))
    full = F.when(has_unit, value).otherwise(F.concat(value, unit))
    matches = _pick(name, {n: full.rlike(p) for n, (p, _) in patterns.items()}, F.lit(False))
    bare = name.isin("V-DC", "V-AC") & value.rlike("^[0-9]{2}$") & value.between("10", "50")
    return (F.when(name == "GND", F.lit(None).cast("string"))
            .when(~name.isin(*patterns), value)
            .when(bare, F.concat(tenth(value), F.lit("V")))
            .when(matches, full))


def fits_reading(value: Column, name: Column) -> Column:
    """Stored value when it suits the type, else NULL (reading order: exclusions come first)."""
    patterns = dims.VALUE_PATTERNS["reading"]
    excluded = _pick(name, {n: reduce(lambda a, b: a | b, [value.rlike(p) for p in ps])
                            for n, ps in dims.ANTI_PATTERNS_READING.items()}, F.lit(False))
    unit = _pick(name, {n: F.lit(u) for n, (_, u) in patterns.items()}, F.lit(""))
    tested = F.when(value.rlike(dims.UNIT_END), value).otherwise(F.concat(value, unit))
    ok = _pick(name, {n: tested.rlike(p) for n, (p, _) in patterns.items()}, F.lit(True))
    stored = F.when(value.rlike(r"[ΩFHVAmH]$"), value).otherwise(F.concat(value, unit))
    return F.when((name != "GND") & ~excluded & ok, stored)


def unit_repair(name: Column, conf: Column, value: Column, nearest: Column) -> Column:
    """Sure components whose value lacks a valid unit take the nearest number plus their first unit."""
    units = dims.VALID_UNITS
    valid = _pick(name, {n: reduce(lambda a, b: a | b, [value.endswith(u) for u in us])
                         for n, us in units.items()}, F.lit(True))
    first = _pick(name, {n: F.lit(us[0]) for n, us in units.items()}, F.lit(""))
    num = F.regexp_extract(nearest, _DIGITS_PREFIX, 1)
    return F.when((conf >= dims.SURE_CONF) & (F.coalesce(value, F.lit("")) != "") & ~valid
                  & nearest.rlike("^[0-9.]"), F.concat(num, first)).otherwise(value)


def netlist_value(c: Column) -> Column:
    """Component value as written in netlists."""
    v = F.replace(F.replace(_strip(c), F.lit("Ω"), F.lit("")), F.lit("μ"), F.lit("u"))
    p = r"^([0-9.]+)\s*([kMmunp]?)"
    suffix = F.regexp_extract(v, p, 2)
    return (F.when(F.coalesce(c, F.lit("")) == "", F.lit("1"))
            .when(v.rlike(p), F.concat(F.regexp_extract(v, p, 1), F.when(suffix == "M", F.lit("Meg")).otherwise(suffix)))
            .otherwise(v))


def led_saturation(value: Column) -> Column:
    """Saturation current of an LED model from `vf=`, two volts unless given, as 1e-15."""
    p = r"(?i)vf\s*[=:]\s*([0-9.]+)"
    vf = F.when(value.rlike(p), F.regexp_extract(value, p, 1).try_cast("double")).otherwise(F.lit(2.0))
    vf = F.coalesce(vf, F.lit(2.0))
    return F.format_string("%.0e", F.pow(F.lit(10.0), F.lit(-14.0) - (vf - 1.5) * 2))


def strip_fences(c: Column) -> Column:
    """Without a leading ``` line and a trailing ``` line."""
    t = _strip(c)
    body = F.regexp_replace(t, r"^```[^\n]*\n?", "")
    body = F.regexp_replace(body, r"(^|\n)[^\S\n]*```[^\S\n]*$", "")
    return F.when(t.startswith("```"), _strip(body)).otherwise(t)


def first_json(t: Column) -> Column:
    """Text without fences up to the bracket that closes the first one; unbalanced becomes empty.

    Only brackets of the opening kind count, wherever they stand. The bracket positions alone are
    walked: splitting at the closing kind, the k-th piece ends the value when the pieces so far
    hold no more than k opening brackets.
    """
    def balanced(op: str, cl: str) -> Column:
        parts = F.split(t, "\\" + cl)
        def step(acc, piece):
            opened = acc["open"] + F.length(piece) - F.length(F.replace(piece, F.lit(op), F.lit("")))
            closed, upto = acc["closed"] + 1, acc["upto"] + F.length(piece) + 1
            end = F.when((acc["end"] == 0) & (opened == closed), upto).otherwise(acc["end"])
            return F.struct(opened.cast("int").alias("open"), closed.cast("int").alias("closed"),
                            upto.cast("int").alias("upto"), end.cast("int").alias("end"))
        zero = F.lit(0).cast("int")
        start = F.struct(zero.alias("open"), zero.alias("closed"), zero.alias("upto"), zero.alias("end"))
        # the last piece has no closing bracket behind it
        inner = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.substring(t, F.lit(1), F.aggregate(inner, start, step)["end"])

    return (F.when(t.startswith("["), balanced("[", "]")).when(t.startswith("{"), balanced("{", "}")).otherwise(t))


def encode(c: Column, alphabet: str = dims.READABLE) -> Column:
    """Character ids from 1 in alphabet order; unknown characters dropped; nothing left -> [0]."""
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    ids = F.filter(F.transform(chars, lambda ch: F.position(ch, F.lit(alphabet))), lambda i: i > 0)
    ids = F.when(F.size(ids) == 0, F.array(F.lit(0))).otherwise(ids)
    return ids


def decode(ids: Column, alphabet: str = dims.READABLE) -> Column:
    """Ids to text: repeats collapsed, blanks (0) dropped."""
    kept = F.filter(ids, lambda x, i: (x != 0) & ((i == 0) | (x != F.get(ids, i - 1))))
    return F.array_join(F.transform(kept, lambda x: F.substring(F.lit(alphabet), x, F.lit(1))), "")
