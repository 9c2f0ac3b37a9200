"""Column functions that several operators share."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType, TimestampNTZType, TimestampType

from riskloom.config import SEVERITIES


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside functions over arrays, Spark computes a repeated expression each time.

    It is a fold over no elements, whose start is the value and whose end the body. An element taken from an array of one would
    do, too, but Spark works out an element's type, and for it walks the whole body, for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, x: a, body)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity(label: Column) -> Column:
    """A known severity in lower case; anything else, null too, counts as critical."""
    plain = F.lower(F.trim(label))
    return F.when(plain.isin(*SEVERITIES), plain).otherwise("critical")


def severity_rank(label: Column) -> Column:
    """0 for info to 4 for critical."""
    return literal_map({s: i for i, s in enumerate(SEVERITIES)})[severity(label)]


def downgrade(label: Column) -> Column:
    """One severity lower; info stays."""
    return F.get(F.array(*map(F.lit, SEVERITIES)), F.greatest(severity_rank(label) - 1, F.lit(0)))


def any_match(text: Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    """Whether one of the patterns is found; each is a literal, compiled once."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(flags + p)
    return out


def chained_sha256(items: Column, seed: str = "", step=None) -> Column:
    """Folds an array into a hash chain: step(previous hash, item) is the text that is hashed for each item."""
    step = step or (lambda last, item: F.concat(last, item))
    return F.aggregate(items, F.lit(seed), lambda last, item: F.sha2(step(last, item), 256))


# How JSON writes the characters (by number) that it must not hold as they are; other control characters go by
# number.
ESCAPES = {92: r"\\", 34: r"\"", 10: r"\n", 13: r"\r", 9: r"\t", 8: r"\b", 12: r"\f"}


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with name standing for value, computed once as let does it."""
    return f"aggregate(cast(array() as array<int>), {value}, (_z, _o) -> _z, {name} -> {body})"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _json_string(text: str) -> str:
    """SQL of a string in JSON; most have nothing to escape, and few of the rest anything but ESCAPES."""
    swapped = reduce(lambda out, pair: f"replace({out}, char({pair[0]}), r'{pair[1]}')", ESCAPES.items(), "_t")
    rare = r"array_join(transform(regexp_extract_all(_p, r'(?s).', 0), _c -> if(ascii(_c) < 32, concat(r'\u00', lower(lpad(hex(ascii(_c)), 2, '0'))), _c)), '')"
    plain = _let("_p", swapped, rf"if(_p rlike r'[\x00-\x1f]', {rare}, _p)")
    return _let("_t", text, rf"""concat('"', if(_t rlike r'[\x00-\x1f"\\]', {plain}, _t), '"')""")


def _json_double(value: str) -> str:
    """SQL of the fewest digits that give a double, laid out with a point from 1e-4 up to 1e16 and else as 1e+16, 1e-05.

    The JVM's own text may have a digit too many: one of 15, 16 or 17 digits that gives the same number goes before it.
    """
    shorter = ", ".join(_let("_f", f"format_string('%.{n}e', _d)", "if(cast(_f as double) = _d, _f, null)") for n in (14, 15, 16))
    # Of 15 digits or fewer no two texts give the same number, so such a text has no shorter one.
    text = _let("_j", "cast(_d as string)", f"replace(if(length(substring_index(_j, 'E', 1)) <= 16, _j, coalesce({shorter}, _j)), 'E', 'e')")
    parts = "named_struct('sign', if(startswith(_s, '-'), '-', ''), 'whole', ltrim('-', substring_index(_s, '.', 1)), 'part', substring_index(substring_index(_s, 'e', 1), '.', -1), 'e', if(contains(_s, 'e'), cast(substring_index(_s, 'e', -1) as int), 0))"
    every = "concat(_v.whole, _v.part)"
    taken = f"named_struct('sign', _v.sign, 'digits', rtrim('0', ltrim('0', {every})), 'e', _v.e + length(_v.whole) - 1 - (length({every}) - length(ltrim('0', {every}))))"
    fixed = "case when _n.e >= length(_n.digits) - 1 then concat(rpad(_n.digits, _n.e + 1, '0'), '.0') when _n.e >= 0 then concat(substring(_n.digits, 1, _n.e + 1), '.', substring(_n.digits, _n.e + 2)) else concat('0.', repeat('0', -_n.e - 1), _n.digits) end"
    wide = "concat(substring(_n.digits, 1, 1), if(length(_n.digits) > 1, concat('.', substring(_n.digits, 2)), ''), if(_n.e < 0, 'e-', 'e+'), lpad(cast(abs(_n.e) as string), greatest(length(cast(abs(_n.e) as string)), 2), '0'))"
    laid = _let("_v", parts, _let("_n", taken, f"concat(_n.sign, case when _n.digits = '' then '0.0' when _n.e between -4 and 15 then {fixed} else {wide} end)"))
    # The JVM lays out what it writes without an exponent as is wanted.
    text = _let("_s", text, f"if(length(_s) <= 16 and not contains(_s, 'e'), _s, {laid})")
    return _let("_d", value, f"case when _d is null then null when isnan(_d) or abs(_d) = double('infinity') then cast(raise_error('canonical JSON has no numbers that aren\\'t finite') as string) else {text} end")


def _sorted(value: str, kind: DataType, depth: int) -> str | None:
    """SQL of a value whose structs have their fields in order, for types that Spark's own JSON writes in the canonical way;
    None for others."""
    if isinstance(kind, (StringType, IntegralType, BooleanType)):
        return value
    if isinstance(kind, ArrayType):
        x = f"_y{depth}"
        inner = _sorted(x, kind.elementType, depth + 1)
        return inner and (value if inner == x else f"transform({value}, {x} -> {inner})")
    if isinstance(kind, StructType) and kind.fields:
        names = kind.names
        parts = {f.name: (f"{value}.{_quoted(f.name)}", f.dataType) for f in kind.fields}
        inner = {n: _sorted(v, t, depth + 1) for n, (v, t) in parts.items()}
        if len(inner) < len(names) or not all(inner.values()):
            return None
        if names == sorted(names) and all(inner[n] == parts[n][0] for n in names):
            return value
        return f"if({value} is null, null, named_struct({', '.join(f'{_literal(n)}, {inner[n]}' for n in sorted(names))}))"
    return None


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def canonical(value: str, kind: DataType, depth: int = 0, native: bool = True) -> str:
    """SQL of the one JSON text of a value of any nested type, itself given as SQL: keys sorted at every level, no white
    space, nulls kept, strings as they are (no Unicode normalisation), dates and times in ISO 8601, other types as strings.
    Numbers that aren't finite are an error. It is SQL and no Column since it is long: the driver hands it over at once.

    Structs and arrays of strings, whole numbers and booleans are written by Spark's own JSON, at a fraction of the cost. Where
    it numbers a character, which it does in capitals, or may have met bytes that are no text, the long way is taken.
    """
    ordered = _sorted(value, kind, depth) if native and isinstance(kind, (StructType, ArrayType)) else None
    if ordered:
        long_way = canonical(value, kind, depth, native=False)
        return _let("_w", f"to_json({ordered}, map('ignoreNullFields', 'false'))", rf"if(contains(_w, r'\u00') or contains(_w, '�'), {long_way}, coalesce(_w, 'null'))")
    x = f"_x{depth}"
    named = lambda n: _literal(json.dumps(n, ensure_ascii=False) + ":")
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = ", ',', ".join(f"{named(f.name)}, {canonical(f'{value}.{_quoted(f.name)}', f.dataType, depth + 1, native)}" for f in fields)
        text = f"if({value} is null, null, concat('{{', {parts + ', ' if parts else ''}'}}'))"
    elif isinstance(kind, ArrayType):
        text = f"concat('[', array_join(transform({value}, {x} -> {canonical(x, kind.elementType, depth + 1, native)}), ','), ']')"
    elif isinstance(kind, MapType):
        entry = f"named_struct('k', cast({x}.key as string), 'v', {canonical(f'{x}.value', kind.valueType, depth + 1, native)})"
        joined = f"concat({_json_string(f'{x}.k')}, ':', {x}.v)"
        text = f"concat('{{', array_join(transform(array_sort(transform(map_entries({value}), {x} -> {entry})), {x} -> {joined}), ','), '}}')"
    elif isinstance(kind, (IntegralType, BooleanType)):
        text = f"cast({value} as string)"
    elif isinstance(kind, (DoubleType, FloatType)):
        text = _json_double(f"cast({value} as double)")
    elif isinstance(kind, DateType):
        text = _json_string(f"date_format({value}, 'yyyy-MM-dd')")
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        zone = "''" if isinstance(kind, TimestampNTZType) else f"date_format({value}, 'xxx')"
        text = _json_string(rf"concat(date_format({value}, r'yyyy-MM-dd\'T\'HH:mm:ss'), regexp_replace(date_format({value}, '.SSSSSS'), r'^\.0+$', ''), {zone})".replace(r"r'yyyy-MM-dd\'T\'HH:mm:ss'", '"yyyy-MM-dd\'T\'HH:mm:ss"'))
    elif isinstance(kind, NullType):
        text = "null"
    else:
        text = _json_string(f"cast({value} as string)")
    return f"coalesce({text}, 'null')"


def uuid5_url(name: Column) -> Column:
    """UUIDv5 of a name in the URL namespace."""
    space = "6ba7b8119dad11d180b400c04fd430c8"
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
