"""Named column rules a mapping row can call (B1-B16) and their registry.

Each rule is a plain ``Column`` expression built from ``pyspark.sql.functions``
so it stays JVM-side inside whole-stage codegen.  The helpers pin the
semantics where Spark and Postgres differ (NULL in CONCAT, ties in ROUND,
float -> int casts).
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


# B1
def copy(c: ColumnLike) -> Column:
    return _c(c)


# B2: CONCAT that treats NULL parts as '' (separator always kept)
def concat_nullsafe(*parts: ColumnLike) -> Column:
    return F.concat(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


def concat_space(first: ColumnLike, last: ColumnLike) -> Column:
    return concat_nullsafe(first, F.lit(" "), last)


# TRIM(LOWER(x)) -- trims spaces only
def clean_email(c: ColumnLike) -> Column:
    return F.trim(F.lower(_c(c)))


# ISO-8601 string -> date, malformed aborts (ANSI cast)
def iso_date(c: ColumnLike) -> Column:
    return _c(c).cast("date")


# Round half to even, then int (Postgres ROUND on DOUBLE PRECISION)
def round_int(c: ColumnLike) -> Column:
    return F.bround(_c(c).cast("double"), 0).cast("int")


# Simple CASE with ELSE default; NULL code -> default
def code_case(c: ColumnLike, mapping: dict[str, str], default: str | None) -> Column:
    col = _c(c)
    expr = None
    for code, value in mapping.items():
        expr = (F.when(col == F.lit(code), F.lit(value)) if expr is None
                else expr.when(col == F.lit(code), F.lit(value)))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


# Equality test, NULL stays NULL
def flag_bool(c: ColumnLike, true_value: str = "Y") -> Column:
    return _c(c) == F.lit(true_value)


# One timestamp for the whole load
def load_time(load_ts: str | None = None) -> Column:
    if load_ts is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.lit(load_ts).cast("timestamp_ntz")


# COALESCE(expr, default); a default such as NOW() is an expression
def with_default(c: ColumnLike, default: str, load_ts: str | None = None) -> Column:
    return F.coalesce(_c(c), default_value_column(default, load_ts))


def default_value_column(default: str, load_ts: str | None = None) -> Column:
    d = default.strip()
    if re.fullmatch(r"(?i)(now|current_timestamp)\s*\(\s*\)", d):
        return load_time(load_ts)
    if re.fullmatch(r"-?\d+", d):
        return F.lit(int(d))
    if re.fullmatch(r"-?\d*\.\d+", d):
        return F.lit(float(d))
    if len(d) >= 2 and d[0] == d[-1] == "'":
        return F.lit(d[1:-1].replace("''", "'"))
    return F.lit(d)


# Explicit cast when families differ; float -> int goes through bround
def type_cast(c: ColumnLike, target_type: str, source_family: str | None = None) -> Column:
    spark_type = spark_type_name(target_type)
    col = _c(c)
    if source_family == "float" and spark_type in ("int", "bigint", "smallint"):
        return F.bround(col, 0).cast(spark_type)
    return col.cast(spark_type)


# Cast, bad value -> NULL
def safe_cast(c: ColumnLike, target_type: str) -> Column:
    return _c(c).try_cast(spark_type_name(target_type))


# INITCAP(TRIM(x))
def title_case(c: ColumnLike) -> Column:
    return F.initcap(F.trim(_c(c)))


# Arithmetic + round to 1 decimal
def unit_convert(c: ColumnLike, divisor: float = 2.54, scale: int = 1) -> Column:
    return F.round(_c(c) / F.lit(divisor), scale)


# Parse with an explicit pattern
def parse_date_fmt(c: ColumnLike, fmt: str = "yyyy-MM-dd") -> Column:
    return F.to_date(_c(c), fmt)


# Zone-less local value read as UTC (session zone is UTC)
def utc_timestamp(c: ColumnLike) -> Column:
    return F.to_utc_timestamp(_c(c).cast("timestamp"), "UTC")


# Trim, collapse whitespace, '' -> NULL
def clean_string(c: ColumnLike) -> Column:
    return F.nullif(F.trim(F.regexp_replace(_c(c), r"\s+", " ")), F.lit(""))


# Declared type name -> Spark SQL type name.
_SPARK_TYPES = {
    "VARCHAR": "string", "TEXT": "string", "STRING": "string", "CHAR": "string",
    "INT": "int", "INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "INT64": "bigint",
    "FLOAT": "double", "FLOAT64": "double", "DOUBLE": "double", "DOUBLE PRECISION": "double",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "DATETIME": "timestamp_ntz",
    "BOOL": "boolean", "BOOLEAN": "boolean",
}


def spark_type_name(declared: str) -> str:
    t = declared.strip().upper()
    m = re.fullmatch(r"(NUMERIC|DECIMAL)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", t)
    if m:
        return f"decimal({m.group(2)},{m.group(3)})"
    m = re.fullmatch(r"(NUMERIC|DECIMAL)\s*\(\s*(\d+)\s*\)", t)
    if m:
        return f"decimal({m.group(2)},0)"
    if t in ("NUMERIC", "DECIMAL"):
        return "decimal(38,18)"  # the widest scale that keeps 20 digits before the point
    base = t.split("(")[0].strip()
    return _SPARK_TYPES.get(t, _SPARK_TYPES.get(base, "string"))


# ---------------------------------------------------------------------------
# K1: rule registry.  A mapping row names a rule in `transformation_rule` as
# `name`, `name(arguments)` or by one of the alias phrases below; the match is
# exact, and an unknown rule is an error of its row.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class RuleCall:
    """A rule's name and arguments: numbers, 'literals' and column names."""
    name: str
    columns: tuple[str, ...] = ()
    values: tuple[str | int | float, ...] = ()


class RuleError(ValueError):
    pass


def _pairs(values: tuple) -> tuple[dict, object]:
    """code_case arguments: code, value, code, value, ..., default."""
    if len(values) % 2 == 0:
        raise RuleError("code_case needs code, value pairs and a default")
    return dict(zip(values[:-1:2], values[1:-1:2])), values[-1]


# name -> (columns taken, values taken at most, function of (columns, values, load time, target type))
RULES: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "copy": (1, 0, lambda c, v, ts, t: copy(c[0])),
    "concat_space": (2, 0, lambda c, v, ts, t: concat_space(*c)),
    "clean_email": (1, 0, lambda c, v, ts, t: clean_email(c[0])),
    "iso_date": (1, 0, lambda c, v, ts, t: iso_date(c[0])),
    "round_int": (1, 0, lambda c, v, ts, t: round_int(c[0])),
    "code_case": (1, None, lambda c, v, ts, t: code_case(c[0], *_pairs(v))),
    "flag_bool": (1, 1, lambda c, v, ts, t: flag_bool(c[0], *v)),
    "load_time": (0, 0, lambda c, v, ts, t: load_time(ts)),
    "type_cast": (1, 0, lambda c, v, ts, t: type_cast(c[0], t)),
    "safe_cast": (1, 0, lambda c, v, ts, t: safe_cast(c[0], t)),
    "title_case": (1, 0, lambda c, v, ts, t: title_case(c[0])),
    "unit_convert": (1, 2, lambda c, v, ts, t: unit_convert(c[0], *v)),
    "parse_date_fmt": (1, 1, lambda c, v, ts, t: parse_date_fmt(c[0], *v)),
    "utc_timestamp": (1, 0, lambda c, v, ts, t: utc_timestamp(c[0])),
    "clean_string": (1, 0, lambda c, v, ts, t: clean_string(c[0])),
}

# Phrases and macro names of the sample inputs that stand for a
# rule (compared after lower-casing, runs of other characters as `_`), and the
# code table of the sample's lookup macro.
SITE_CODES = ("01", "Chennai", "02", "Mumbai", "03", "Delhi", "Unknown")
RULE_ALIASES = {
    "copy_as_is": RuleCall("copy"),
    "clean_email_trim_whitespace_and_lowercase": RuleCall("clean_email"),
    "cleanemail": RuleCall("clean_email"),
    "parse_iso_8601_string_to_date": RuleCall("iso_date"),
    "round_to_nearest_integer": RuleCall("round_int"),
    "stamp_load_time": RuleCall("load_time"),
    "sitelookup": RuleCall("code_case", (), SITE_CODES),
    "cleanstring": RuleCall("clean_string"),
}


def normalise_rule_text(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.strip().lower()).strip("_")


_ARGUMENT = re.compile(r"\s*(?:'((?:[^']|'')*)'|(-?\d+(?:\.\d+)?)|([A-Za-z_]\w*))\s*(,|$)")


def _arguments(text: str) -> tuple[list[str], list]:
    columns, values, at = [], [], 0
    while text.strip() and at < len(text):
        m = _ARGUMENT.match(text, at)
        if not m:
            raise RuleError(f"cannot read the rule arguments ({text})")
        literal, number, name, _ = m.groups()
        if name is not None:
            columns.append(name)
        elif literal is not None:
            values.append(literal.replace("''", "'"))
        else:
            values.append(float(number) if "." in number else int(number))
        at = m.end()
    return columns, values


def resolve_rule(text: str) -> RuleCall | None:
    """The rule a sheet's `transformation_rule` calls; None when it is blank (type-driven).

    Raises RuleError for anything that is neither a rule nor an alias."""
    if not text or not text.strip():
        return None
    key = normalise_rule_text(text)
    if key in RULE_ALIASES:
        return RULE_ALIASES[key]
    call = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(?:\((.*)\))?\s*", text, re.S)
    name = normalise_rule_text(call.group(1)) if call else None
    alias = RULE_ALIASES.get(name)
    if name not in RULES and alias is None:
        raise RuleError(f'unknown transformation rule "{text.strip()}"')
    columns, values = _arguments(call.group(2) or "")
    base = alias or RuleCall(name)
    return RuleCall(base.name, tuple(columns), tuple(values) or base.values)


def rule_column(call: RuleCall, source_field: str, load_ts: str | None, target_type: str) -> Column:
    """The rule applied: to the columns it names, else to the row's source field."""
    n_columns, n_values, fn = RULES[call.name]
    columns = call.columns or ((source_field,) if source_field else ())
    if n_columns == len(columns) + 1 and source_field and call.columns:
        columns = (source_field, *columns)  # concat_space(last) joins the source field with another
    if n_columns and len(columns) != n_columns:
        raise RuleError(f"rule {call.name} takes {n_columns} column(s), not {len(columns)}")
    if n_values is not None and len(call.values) > n_values:
        raise RuleError(f"rule {call.name} takes at most {n_values} value(s), not {len(call.values)}")
    return fn(columns, call.values, load_ts, target_type)


# Declared text lengths
_LIMITED = re.compile(r"\s*(?:VARCHAR|CHARACTER\s+VARYING|CHAR|CHARACTER)\s*\(\s*(\d+)\s*\)\s*", re.I)


def length_limit(type_name: str | T.DataType) -> int | None:
    """The n of `VARCHAR(n)` and its like."""
    m = _LIMITED.fullmatch(type_name) if isinstance(type_name, str) else None
    return int(m[1]) if m else None


def declared_value(col: Column, declared: str | T.DataType, name: str) -> Column:
    """`col` as a value of a declared column: cast, and of a limited text type at most that long.
    Blanks beyond the limit are cut off, anything else beyond it is an error when the row is written."""
    n = length_limit(declared)
    if n is None:
        return col.cast(declared)
    text = col.cast("string")
    blank = F.rtrim(F.substring(text, F.lit(n + 1), F.length(text))) == ""
    error = F.raise_error(F.lit(f'value too long for column "{name}" of type {declared.strip()}'))
    return F.when(F.length(text) <= n, text).when(text.isNull(), text).when(blank, F.substring(text, 1, n)).otherwise(error.cast("string"))
