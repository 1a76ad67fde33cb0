"""The functions of the SQL dialect, as rewrites of calls into Spark's own expressions, and as Column builders.

A call becomes an expression before the text is parsed, so everything stays in
Catalyst: no Python runs for each row, and the session's built-ins are not
replaced. `OWN` holds what the dialect itself defines (argument orders, group
numbering and null rules that differ from Spark's functions of the same name);
`COMPAT` holds the names of SQLite's built-ins whose behaviour differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import errors
from textloom.errors import EngineError
from textloom.operators.sqltext import glob_match

EXT = r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$"
BASENAME = r"([^/]*)$"

#: Tokens of Python's regular expressions that Java writes otherwise.
_DIALECT = ((r"\(\?P<(\w+)>", r"(?<\1>"), (r"\(\?P=(\w+)\)", r"\\k<\1>"), (r"\\Z", r"\\z"))


def java_pattern(pattern: str) -> str:
    for old, new in _DIALECT:
        pattern = re.sub(old, new, pattern)
    return pattern


def _pattern_literal(text: str) -> str:
    """A pattern argument: literals are translated and escaped for Spark's parser, others pass."""
    m = re.fullmatch(r"'((?:[^']|'')*)'", text.strip(), re.S)
    return "'" + java_pattern(m[1].replace("''", "'")).replace("\\", "\\\\").replace("'", "\\'") + "'" if m else text


def _need(name: str, args: list[str], *counts: int) -> None:
    if len(args) not in counts:
        raise EngineError(errors.SQL, f"Function {name} takes {' or '.join(map(str, counts))} arguments, not {len(args)}")


def _s(x: str) -> str:
    return f"cast(({x}) as string)"


def _regexp(a: list[str]) -> str:
    _need("regexp", a, 2)
    return f"cast(coalesce({_s(a[1])} rlike {_pattern_literal(a[0])}, false) as int)"


def _regexp_extract(a: list[str]) -> str:
    _need("regexp_extract", a, 3)
    p, x = _pattern_literal(a[0]), _s(a[1])
    return f"(case when ({a[1]}) is null then '0' when {x} rlike {p} then regexp_extract({x}, {p}, ({a[2]}) + 1) end)"


def _encoded(x: str, encoding: str) -> str:
    return f"encode({_s(x)}, {encoding})"


def _md5(a: list[str]) -> str:
    _need("md5", a, 1, 2)
    return f"md5({_encoded(a[0], a[1] if len(a) > 1 else chr(39) + 'utf-8' + chr(39))})"


def _sha(a: list[str]) -> str:
    _need("sha", a, 2, 3)
    x, bits = _encoded(a[0], a[2] if len(a) > 2 else "'utf-8'"), a[1].strip()
    if bits == "1":
        return f"sha1({x})"
    if bits in ("224", "256", "384", "386", "512"):
        return f"sha2({x}, {384 if bits == '386' else bits})"
    return f"(case cast({bits} as int) when 1 then sha1({x}) when 224 then sha2({x}, 224) when 256 then sha2({x}, 256) when 384 then sha2({x}, 384) when 386 then sha2({x}, 384) when 512 then sha2({x}, 512) end)"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _ext(x: str) -> str:
    return f"regexp_extract({_s(x)}, {_q(EXT)}, 1)"


def _basename(x: str) -> str:
    return f"regexp_extract({_s(x)}, {_q(BASENAME)}, 1)"


def _folder(a: list[str]) -> str:
    _need("file_folder", a, 1)
    head = f"regexp_extract({_s(a[0])}, '^(.*/)', 1)"
    return f"if({head} rlike '^/*$', {head}, rtrim('/', {head}))"


def _no_ext(a: list[str]) -> str:
    _need("file_basename_no_ext", a, 1)
    b = _basename(a[0])
    return f"substring({b}, 1, length({b}) - length({_ext(a[0])}))"


def _one(name: str, make: Callable[[str], str]) -> Callable[[list[str]], str]:
    def call(a: list[str]) -> str:
        _need(name, a, 1)
        return make(a[0])

    return call


OWN: dict[str, Callable[[list[str]], str | None]] = {
    "regexp": _regexp,
    "regexp_extract": _regexp_extract,
    "md5": _md5,
    "sha1": _one("sha1", lambda x: f"sha1({_s(x)})"),
    "sha": _sha,
    "sqrt": _one("sqrt", lambda x: f"sqrt({x})"),
    "power": lambda a: f"power({a[0]}, {a[1]})" if len(a) == 2 else _need("power", a, 2),  # type: ignore[func-returns-value]
    "file_ext": _one("file_ext", _ext),
    "file_folder": _folder,
    "file_basename": _one("file_basename", _basename),
    "file_basename_no_ext": _no_ext,
    "percentile": lambda a: f"(case when ({a[1]}) between 0 and 1 then percentile({a[0]}, least(1d, greatest(0d, cast(({a[1]}) as double)))) end)" if len(a) == 2 and not a[1].strip().lower().startswith(("array", "[")) else None,
    "stddev_pop": _one("stddev_pop", lambda x: f"(case when count({x}) > 1 then stddev_pop({x}) end)"),
    "stddev_sample": _one("stddev_sample", lambda x: f"stddev_samp({x})"),
}

#: What -L prints.
DESCRIPTIONS = {
    "regexp(<regular expression>, <expr>)": "1 if the expression matches anywhere, else 0; null gives 0",
    "regexp_extract(<regular expression>, <expr>, <group>)": "the group, counted from 0, of the first match; null without one",
    "md5(<expr>, <encoding>)": "MD5 in hexadecimal",
    "sha1(<expr>)": "SHA-1 in hexadecimal",
    "sha(<expr>, <1|224|256|384|512>, <encoding>)": "SHA of that many bits in hexadecimal",
    "sqrt(<expr>)": "square root",
    "power(<expr>, <power>)": "raised to a power",
    "file_ext(<path>)": "extension with its dot",
    "file_folder(<path>)": "folder",
    "file_basename(<path>)": "name without folder",
    "file_basename_no_ext(<path>)": "name without folder and extension",
    "percentile(<expr>, <0 to 1>)": "aggregate: interpolated percentile",
    "stddev_pop(<expr>)": "aggregate: population standard deviation, null for one value",
    "stddev_sample(<expr>)": "aggregate: sample standard deviation",
}

_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "y": "yy", "I": "hh", "p": "a"}


def _moment(value: str, modifiers: list[str]) -> str:
    """A timestamp expression for SQLite's time values and modifiers; null where it isn't one."""
    v = value.strip()
    mods = [m.strip().strip("'").lower() for m in modifiers]
    if v.lower() in ("'now'",):
        out = "current_timestamp()"
    elif "unixepoch" in mods[:1]:
        out, mods = f"timestamp_seconds(cast(({v}) as double))", mods[1:]
    elif "auto" in mods[:1]:
        out, mods = f"timestamp_seconds(cast(({v}) as double))", mods[1:]
    else:
        out = f"coalesce(try_cast(({v}) as timestamp), timestamp_seconds(try_cast(cast(({v}) as string) as double) * 86400D - 210866760000D))"
    for m in mods:
        if k := re.fullmatch(r"start of (day|month|year)", m):
            out = f"date_trunc('{k[1]}', {out})"
        elif k := re.fullmatch(r"([+-]?[0-9.]+) (second|minute|hour|day|month|year)s?", m):
            if k[2] in ("month", "year"):
                out = f"({out} + make_ym_interval({int(float(k[1])) if k[2] == 'year' else 0}, {int(float(k[1])) if k[2] == 'month' else 0}))"
            else:
                seconds = float(k[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[k[2]]
                out = f"timestamp_seconds(cast(unix_micros({out}) as double) / 1000000D + ({seconds}))"
        elif k := re.fullmatch(r"([+-])(\d\d):(\d\d)(?::(\d\d))?", m):
            seconds = (int(k[2]) * 3600 + int(k[3]) * 60 + int(k[4] or 0)) * (-1 if k[1] == "-" else 1)
            out = f"timestamp_seconds(cast(unix_micros({out}) as double) / 1000000D + ({seconds}))"
        elif k := re.fullmatch(r"weekday ([0-6])", m):
            out = f"({out} + make_dt_interval(cast(pmod({k[1]} - (dayofweek({out}) - 1), 7) as int)))"
        elif m in ("utc", "localtime", "subsec", "subsecond"):
            continue
        else:
            raise EngineError(errors.SQL, f"Time modifier '{m}' is not known")
    return out


def _formatted(pattern: str) -> Callable[[list[str]], str]:
    def call(a: list[str]) -> str:
        return f"date_format({_moment(a[0] if a else chr(39) + 'now' + chr(39), a[1:])}, '{pattern}')"

    return call


def _strftime(a: list[str]) -> str | None:
    m = re.fullmatch(r"'((?:[^']|'')*)'", a[0].strip()) if a else None
    if not m:
        return None
    t = _moment(a[1] if len(a) > 1 else "'now'", a[2:])
    parts: list[str] = []
    pattern = ""
    at = 0
    raw = m[1].replace("''", "'")
    while at < len(raw):
        c = raw[at]
        code = raw[at + 1 : at + 2] if c == "%" else ""
        if c == "%" and code in ("s", "w", "J", "W", "u"):
            if pattern:
                parts.append(f"date_format({t}, '{pattern}')")
                pattern = ""
            parts.append({"s": f"cast(unix_seconds({t}) as string)", "w": f"cast(dayofweek({t}) - 1 as string)", "J": f"cast(unix_micros({t}) / 86400000000D + 2440587.5D as string)", "W": f"lpad(cast(cast((dayofyear({t}) + 6 - pmod(dayofweek({t}) + 5, 7)) / 7 as int) as string), 2, '0')", "u": f"cast(pmod(dayofweek({t}) + 5, 7) + 1 as string)"}[code])
            at += 2
        elif c == "%" and code in _STRFTIME:
            pattern += _STRFTIME[code]
            at += 2
        elif c == "%" and code == "%":
            pattern += "''%''".replace("''", "\\'")
            at += 2
        else:
            pattern += f"\\'{c}\\'" if c.isalpha() else ("\\'\\'" if c == "'" else c)
            at += 1
    if pattern:
        parts.append(f"date_format({t}, '{pattern}')")
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def _substr(a: list[str]) -> str | None:
    """Positions from 1; position 0 stands before the first character, and a negative length runs to the left."""
    if len(a) == 2:
        return f"substring({_s(a[0])}, {a[1]})"
    if len(a) != 3:
        return None
    s, p, n = _s(a[0]), f"({a[1]})", f"({a[2]})"
    if re.fullmatch(r"\d+", a[1].strip()) and re.fullmatch(r"\d+", a[2].strip()):
        p0, n0 = int(a[1]), int(a[2])
        return f"substring({s}, 1, {max(0, n0 - 1)})" if p0 == 0 else f"substring({s}, {p0}, {n0})"
    begin = f"(case when {p} > 0 then {p} when {p} = 0 then 0 else greatest(length({s}) + {p} + 1, {p} + length({s}) + 1) end)"
    lo = f"(case when {n} < 0 then {begin} + {n} else {begin} end)"
    hi = f"(case when {n} < 0 then {begin} else {begin} + {n} end)"
    return f"substring({s}, cast(greatest(1, {lo}) as int), cast(greatest(0, {hi} - greatest(1, {lo})) as int))"


def _printf(a: list[str]) -> str | None:
    m = re.fullmatch(r"'((?:[^']|'')*)'", a[0].strip()) if a else None
    if not m:
        return None
    codes = re.findall(r"%[-+ 0#,]*\d*(?:\.\d+)?([a-zA-Z%])", m[1])
    kinds = [c for c in codes if c != "%"]
    cast = {"d": "bigint", "i": "bigint", "u": "bigint", "x": "bigint", "X": "bigint", "o": "bigint", "f": "double", "e": "double", "E": "double", "g": "double", "G": "double", "s": "string", "c": "string"}
    args = [f"cast(({x}) as {cast.get(k, 'string')})" for x, k in zip(a[1:], kinds, strict=False)]
    text = re.sub(r"(%[-+ 0#,]*\d*(?:\.\d+)?)[iu]", r"\1d", a[0])
    return f"format_string({', '.join([text, *args])})"


def _null_if_any(fold: str) -> Callable[[list[str]], str | None]:
    def call(a: list[str]) -> str | None:
        if len(a) < 2:
            return None
        return f"(case when {' or '.join(f'({x}) is null' for x in a)} then null else {fold}({', '.join(a)}) end)"

    return call


def _json_extract(a: list[str]) -> str:
    return f"get_json_object({a[0]}, {a[1]})" if len(a) == 2 else f"to_json(array({', '.join(f'get_json_object({a[0]}, {p})' for p in a[1:])}))"


COMPAT: dict[str, Callable[[list[str]], str | None]] = {
    "generate_series": lambda a: f"(select id as value from range({a[0]}, ({a[1]}) + 1{', ' + a[2] if len(a) > 2 else ''}))" if len(a) in (2, 3) else None,
    "group_concat": lambda a: f"listagg({a[0].replace('DISTINCT', 'distinct')}, {a[1] if len(a) > 1 else chr(39) + ',' + chr(39)})",
    "string_agg": lambda a: f"listagg({', '.join(a)})",
    "total": _one("total", lambda x: f"coalesce(cast(sum({x}) as double), 0d)"),
    "glob": lambda a: f"cast({glob_match(a[0], a[1])} as int)" if len(a) == 2 else None,
    "like": lambda a: f"cast((({a[1]}) ilike {a[0]}) as int)" if len(a) == 2 else None,
    "iif": lambda a: f"if({', '.join(a)})",
    "substr": _substr,
    "substring": _substr,
    "ltrim": lambda a: f"ltrim({a[1]}, {a[0]})" if len(a) == 2 else None,
    "rtrim": lambda a: f"rtrim({a[1]}, {a[0]})" if len(a) == 2 else None,
    "trim": lambda a: f"trim(BOTH {a[1]} FROM {a[0]})" if len(a) == 2 else None,
    "unicode": _one("unicode", lambda x: f"ascii({x})"),
    "char": lambda a: f"concat({', '.join(f'decode(encode(char_, {chr(39)}utf-8{chr(39)}), {chr(39)}utf-8{chr(39)})'.replace('char_', f'decode(unhex(lpad(hex({x}), 8, {chr(39)}0{chr(39)})), {chr(39)}utf-32{chr(39)})') for x in a)})",
    "quote": _one("quote", lambda x: f"(case when ({x}) is null then 'NULL' when typeof({x}) = 'string' then concat('''', replace({_s(x)}, '''', ''''''), '''') else {_s(x)} end)"),
    "zeroblob": _one("zeroblob", lambda x: f"repeat(chr(0), {x})"),
    "printf": _printf,
    "format": _printf,
    "log": lambda a: f"log10({a[0]})" if len(a) == 1 else f"log({', '.join(a)})",
    "log10": _one("log10", lambda x: f"log10({x})"),
    "mod": lambda a: f"mod({a[0]}, {a[1]})",
    "trunc": _one("trunc", lambda x: f"cast(cast(({x}) as bigint) as double)"),
    "random": lambda a: "xxhash64(uuid())" if not a else None,
    "min": _null_if_any("least"),
    "max": _null_if_any("greatest"),
    "likely": _one("likely", lambda x: f"({x})"),
    "unlikely": _one("unlikely", lambda x: f"({x})"),
    "likelihood": lambda a: f"({a[0]})",
    "textloom_typeof": lambda a: f"typeof({a[0]})",  # Spark's own, which is settled before the query runs
    "typeof": _one("typeof", lambda x: f"(case when ({x}) is null then 'null' when typeof({x}) in ('int', 'bigint', 'smallint', 'tinyint', 'boolean') then 'integer' when typeof({x}) in ('double', 'float') or typeof({x}) like 'decimal%' then 'real' when typeof({x}) = 'binary' then 'blob' else 'text' end)"),
    "date": _formatted("yyyy-MM-dd"),
    "time": _formatted("HH:mm:ss"),
    "datetime": _formatted("yyyy-MM-dd HH:mm:ss"),
    "strftime": _strftime,
    "julianday": lambda a: f"(unix_micros({_moment(a[0], a[1:])}) / 86400000000D + 2440587.5D)",
    "unixepoch": lambda a: f"unix_seconds({_moment(a[0], a[1:])})",
    "json": _one("json", lambda x: f"to_json(parse_json({x}))"),
    "json_extract": _json_extract,
    "json_valid": _one("json_valid", lambda x: f"cast(try_parse_json({x}) is not null as int)"),
    "json_type": lambda a: f"(case schema_of_variant(try_variant_get(parse_json({a[0]}), {a[1] if len(a) > 1 else chr(39) + '$' + chr(39)}, 'variant')) when 'BIGINT' then 'integer' when 'STRING' then 'text' when 'BOOLEAN' then 'true' when 'VOID' then 'null' when 'DOUBLE' then 'real' else 'object' end)",
    "json_array": lambda a: f"to_json(array({', '.join(a)}))",
    "json_object": lambda a: f"to_json(named_struct({', '.join(a)}))",
    "json_quote": _one("json_quote", lambda x: f"regexp_replace(to_json(named_struct('v', {x})), '^.v.:|^\\\\{{\"v\":|\\\\}}$', '')"),
    "json_group_array": _one("json_group_array", lambda x: f"to_json(collect_list({x}))"),
    "json_group_object": lambda a: f"to_json(map_from_entries(collect_list(struct({a[0]}, {a[1]}))))",
}


# --- the same functions for DataFrames


def regexp(pattern: str, x: Column) -> Column:
    return F.coalesce(x.cast("string").rlike(java_pattern(pattern)), F.lit(False)).cast("int")


def regexp_extract(pattern: str, x: Column, group: int) -> Column:
    p = java_pattern(pattern)
    return F.when(x.cast("string").rlike(p), F.regexp_extract(x.cast("string"), p, group + 1))


def file_ext(x: Column) -> Column:
    return F.regexp_extract(x, EXT, 1)


def file_basename(x: Column) -> Column:
    return F.regexp_extract(x, BASENAME, 1)


def file_folder(x: Column) -> Column:
    head = F.regexp_extract(x, "^(.*/)", 1)
    return F.when(head.rlike("^/*$"), head).otherwise(F.rtrim(head, F.lit("/")))


def file_basename_no_ext(x: Column) -> Column:
    b = file_basename(x)
    return F.substring(b, F.lit(1), F.length(b) - F.length(file_ext(x)))


def stddev_pop(x: Column) -> Column:
    return F.when(F.count(x) > 1, F.stddev_pop(x))


def sha(x: Column, bits: int, encoding: str = "utf-8") -> Column:
    raw = F.encode(x.cast("string"), encoding)
    return F.sha1(raw) if bits == 1 else F.sha2(raw, 384 if bits == 386 else bits)
