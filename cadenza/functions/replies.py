"""Typing of model replies (F1 F2 F4 F5) with VARIANT column expressions.

A reply is parsed once with ``try_parse_json`` (after the fence strip of
F1); each field is then typed from ``schema_of_variant`` of its value,
which separates "absent" (NULL) from "explicit null" ("VOID") and tells
numbers, strings, booleans and arrays apart.  The rules reproduce the
validator's lax mode for the criteria object:

- int fields: integers; fractional-typed numbers equal to their floor;
  strings holding an integer literal, a zero fraction included; booleans
  (0/1).  An integer beyond 64 bits, number or string, is invalid.
- float fields: any number; strings holding a number; booleans.
- str fields: strings only.
- list[str] fields: arrays whose elements are all strings.
- unknown keys are ignored; an absent key takes its default; an explicit
  null is allowed only on the optional fields.

Stated deviations: NaN literals and duplicate keys fail to parse here (the
original parser took them), and whitespace trimming is ASCII-only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import (DEFAULT_DESCRIPTION, DEFAULT_LIMIT, DEFAULT_MARKET,
                                       DEFAULT_TITLE, FALLBACK_QUERY, MAX_QUERIES, clamp_seeds,
                                       strip_fence)

INT_RE = r"^\s*[+-]?[0-9]+(\.0+)?\s*$"
NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")

# (field, kind, nullable, lower bound, upper bound) in the model's order.
CRITERIA_FIELDS = [
    ("seed_genres", "list", False, None, None),
    ("seed_artists", "list", False, None, None),
    ("year_min", "int", True, None, None),
    ("year_max", "int", True, None, None),
    ("target_energy", "float", True, 0.0, 1.0),
    ("target_valence", "float", True, 0.0, 1.0),
    ("target_tempo", "float", True, 0.0, None),
    ("target_danceability", "float", True, 0.0, 1.0),
    ("target_acousticness", "float", True, 0.0, 1.0),
    ("market", "str", False, None, None),
    ("limit", "int", False, 1, 100),
]
DEFAULTS = {"market": DEFAULT_MARKET, "limit": DEFAULT_LIMIT}


def parse_reply(raw_text: Column) -> Column:
    """strip the fence, parse; NULL when the text is not JSON."""
    return F.try_parse_json(strip_fence(raw_text))


def _vtype(v: Column, path: str) -> Column:
    """Type name of the value at ``path``: NULL when absent, 'VOID' for null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_numeric(t: Column) -> Column:
    return t.isin(*_NUMERIC) | t.startswith("DECIMAL")


def _string_list(v: Column, path: str, t: Column) -> Column:
    """True when the value is an array whose elements are all strings.
    The array's own type name says so (``ARRAY<STRING>``; ``ARRAY<VOID>``
    when empty) except for null elements, which merge into either type, so
    those are checked on the cast list."""
    arr = F.try_variant_get(v, path, "array<string>")
    no_nulls = F.size(arr) == F.size(F.array_compact(arr))
    return F.coalesce(((t == "ARRAY<STRING>") & no_nulls) | ((t == "ARRAY<VOID>") & (F.size(arr) == 0)),
                      F.lit(False))


def typed_field(v: Column, name: str, kind: str, nullable: bool, lo, hi, t: Column | None = None,
                path: str | None = None):
    """(value, ok) for one criteria field; ``t`` is its type name if
    already computed; ``path`` defaults to the field's key in ``v``."""
    path = f"$.{name}" if path is None else path
    t = _vtype(v, path) if t is None else t
    absent, void = t.isNull(), t == "VOID"
    default = DEFAULTS.get(name)
    if kind == "list":
        value = F.when(absent, F.array().cast("array<string>")).otherwise(
            F.try_variant_get(v, path, "array<string>"))
        ok = absent | _string_list(v, path, t)
    elif kind == "str":
        value = F.when(absent, F.lit(default)).otherwise(F.try_variant_get(v, path, "string"))
        ok = absent | (t == "STRING")
    else:
        as_double = F.try_variant_get(v, path, "double")
        as_text = F.try_variant_get(v, path, "string")
        if kind == "int":
            whole = F.regexp_extract(as_text, r"[+-]?[0-9]+", 0).try_cast("bigint")
            value = F.when(t == "STRING", whole).otherwise(F.try_variant_get(v, path, "bigint"))
            good = ((_is_numeric(t) & (as_double == F.floor(as_double))) | (t == "BOOLEAN") |
                    ((t == "STRING") & as_text.rlike(INT_RE))) & value.isNotNull()
        else:
            good = _is_numeric(t) | (t == "BOOLEAN") | ((t == "STRING") & as_text.rlike(NUM_RE))
            value = as_double
        in_range = F.lit(True)
        if lo is not None:
            in_range = in_range & (value >= F.lit(lo))
        if hi is not None:
            in_range = in_range & (value <= F.lit(hi))
        ok = absent | (void if nullable else F.lit(False)) | (good & F.coalesce(in_range, F.lit(False)))
        value = F.when(absent | void, F.lit(default)).otherwise(value)
    return F.when(ok, value), ok


def typed_criteria(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """F1 + F2 + F3 for each reply row: adds struct column ``c`` with every
    typed field (seed clamp applied), ``ok`` and the first ``error``.

    The parse, the split into per-field values and each field's type name
    are computed once, each in its own projection: the typing rules
    reference them many times from inside CASE branches, where Spark does
    not share common sub-expressions, and the optimizer keeps a non-trivial
    expression in its own projection when it is used more than once.
    Splitting the object once into small per-field values is ~2.5x faster
    than looking every field up by path in the whole object."""
    parsed = df.withColumn("_v", parse_reply(F.col(text_col)))
    v = F.col("_v")
    # One walk of the object: every field as its own small VARIANT (NULL when
    # the key is absent, VOID when it is null; keys match case-sensitively).
    fields_t = "struct<" + ",".join(f"`{n}`:variant" for n, *_ in CRITERIA_FIELDS) + ">"
    split = parsed.withColumn("_f", F.try_variant_get(v, "$", fields_t))
    typed = split.select("*", *[F.schema_of_variant(F.col(f"_f.{n}")).alias(f"_t_{n}") for n, *_ in CRITERIA_FIELDS],
                         F.col("_f").isNotNull().alias("_obj"))
    values, errors, oks = {}, [], []
    for name, kind, nullable, lo, hi in CRITERIA_FIELDS:
        value, ok = typed_field(F.col(f"_f.{name}"), name, kind, nullable, lo, hi, F.col(f"_t_{name}"), path="$")
        values[name] = value
        oks.append(ok)
        errors.append(F.when(~ok, F.lit(f"invalid:{name}")))
    genres, artists = clamp_seeds(values["seed_genres"], values["seed_artists"])
    values["seed_genres"], values["seed_artists"] = genres, artists
    is_obj = F.col("_obj")
    all_ok = is_obj
    for ok in oks:
        all_ok = all_ok & ok
    error = (F.when(v.isNull(), F.lit("not_json"))
             .when(~is_obj, F.lit("not_object"))
             .otherwise(F.coalesce(*errors)))
    # the limit lies in 1..100 where it is valid, and is NULL elsewhere
    fields = [values[n].cast("int").alias("track_limit") if n == "limit" else values[n].alias(n)
              for n, *_ in CRITERIA_FIELDS]
    out = typed.withColumn("c", F.struct(*fields, all_ok.alias("ok"), F.when(~all_ok, error).alias("error")))
    return out.drop("_v", "_f", "_obj", *[f"_t_{name}" for name, *_ in CRITERIA_FIELDS])


def query_list(v: Column) -> Column:
    """F4 on a parsed reply ``v``: a list of strings keeps its first 6;
    anything else is the one fallback query.  An empty list stays empty
    (the request then has no tracks, P12)."""
    ok = _string_list(v, "$", F.schema_of_variant(v))
    return F.when(ok, F.slice(F.try_variant_get(v, "$", "array<string>"), 1, MAX_QUERIES)) \
        .otherwise(F.array(F.lit(FALLBACK_QUERY)))


def title_pair(v: Column) -> Column:
    """F5 on a parsed reply ``v``: title and description of the object, a
    default for an absent key, an explicit null or a value that is no text; a
    reply that does not parse or is no object gives both defaults."""
    def text(path: str, default: str) -> Column:
        return F.when(_vtype(v, path) == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.lit(default))
    title, desc = text("$.title", DEFAULT_TITLE), text("$.description", DEFAULT_DESCRIPTION)
    return F.struct(title.alias("title"), desc.alias("description"))
