"""Named column transforms and masks; all are expressions, so they stay in whole-stage code.

A transform gets a column and returns one. What can't be converted becomes null: ``converted`` pairs
the value with an error text for the dead-letter split. Unknown names are errors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructType, _parse_datatype_string


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 in UTC of a timestamp without zone, floored."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


#: A time that says its zone: Z, an offset, or a region's name at the end.
ZONED = r"[0-9](Z|\s*(UTC|GMT)?[+-][0-9]{1,2}(:?[0-9]{2}){0,2}|\s*(UTC|GMT)|\s*[A-Za-z]+/[A-Za-z_/]+)\s*$"


def unix_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a time in any form: a text with a zone counts in that zone, a text or timestamp without one in UTC, a timestamp with one as it is."""
    kind = F.typeof(c)
    text = c.cast("string")
    # a date alone has a '-' and digits at its end as an offset has, so an offset must follow a time
    zoned = F.regexp_like(text, F.lit(":[0-9.]*" + ZONED)) | F.regexp_like(text, F.lit("T[0-9]{2}" + ZONED))
    with_zone = F.unix_millis(c.try_cast("timestamp"))
    return F.when((kind == "timestamp") | ((kind == "string") & zoned), with_zone).otherwise(epoch_ms(c.try_cast("timestamp_ntz")))


def _sorted_json(text: Column) -> Column:
    """A JSON text whose objects have their keys in order, at every depth: the variant form keeps them sorted."""
    return F.to_json(F.try_parse_json(text))


def json_text(c: Column) -> Column:
    """A value's own JSON: a text in quotes, a map or struct in braces with its keys in order, null as null."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    inner = F.substr(whole, F.lit(6), F.length(whole) - 6)  # what stands between '{"v":' and '}'
    return F.when(F.typeof(c).contains("map<"), F.coalesce(_sorted_json(inner), inner)).otherwise(inner)


def _uuid_text(c: Column) -> Column:
    """16 bytes as hex with hyphens, bytes of another length as plain hex, anything else as its text."""
    plain = F.lower(F.hex(c))
    return F.when(F.typeof(c) == "binary", F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(c.cast("string"))


def _uuid(c: Column) -> Column:
    return F.when(F.regexp_like(F.replace(c.cast("string"), F.lit("-"), F.lit("")), F.lit("^[0-9a-fA-F]{32}$")), c)


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "none": lambda c: c,
    "": lambda c: c,
    "to_json_string": json_text,
    "from_json_string": lambda c: F.try_parse_json(c),
    "to_unix_ms": unix_ms,
    "from_unix_ms": lambda c: F.timestamp_millis(c.try_cast("bigint")),
    "to_upper": lambda c: F.upper(c.cast("string")),
    "to_lower": lambda c: F.lower(c.cast("string")),
    "uuid_to_string": _uuid_text,
    "string_to_uuid": _uuid,
}


#: Transforms that give struct<value, error> themselves.
RESULTS: dict[str, Callable[[Column], Column]] = {}


def register_transform(name: str, fn: Callable[[Column], Column]) -> None:
    """Adds a transform of one's own that is an expression."""
    RESULTS.pop(name, None)
    TRANSFORMS[name] = fn


def register_function(name: str, fn: Callable[[object], object], returns: str) -> None:
    """Adds a transform of one's own that is a Python function of one value, run in Arrow batches.

    A value that it raises an error for becomes null, and the error's text is what ``converted`` reports. Null
    stays null and never reaches the function. returns: the type of its results, as DDL.
    """
    kind = to_arrow_type(_parse_datatype_string(returns))

    @arrow_udf(f"value {returns}, error string")
    def run(values: pa.Array) -> pa.Array:
        out, errors = [], []
        for v in values.to_pylist():
            error = None
            try:
                v = None if v is None else pa.scalar(fn(v), kind).as_py()
            except Exception as e:  # whatever the function raises is the value's error
                v, error = None, f"{type(e).__name__}: {e}"
            out.append(v)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(out, kind), pa.array(errors, pa.string())], names=["value", "error"])

    RESULTS[name] = run
    TRANSFORMS[name] = lambda c: run(c)["value"]


def transform(name: str, c: Column) -> Column:
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform: {name}")
    return TRANSFORMS[name](c)


def converted(name: str, column: str) -> Column:
    """struct<value, error>: error says which transform failed where the input isn't null."""
    c = F.col(column)
    if name in RESULTS:
        r = RESULTS[name](c)
        return F.struct(r["value"].alias("value"), F.when(r["error"].isNotNull(), F.concat(F.lit(f"{name} failed for {column}: "), r["error"])).alias("error"))
    v = transform(name, c)
    return F.struct(v.alias("value"), F.when(c.isNotNull() & v.isNull(), F.lit(f"{name} failed for {column}")).alias("error"))


def map_columns(df: DataFrame, mappings: dict[str, tuple[str, str]], keep_rest: bool = True) -> DataFrame:
    """One select: {source: (target, transform)}; other columns pass through."""
    out = []
    for c in df.columns:
        if c in mappings:
            target, name = mappings[c]
            out.append(transform(name, F.col(c)).alias(target))
        elif keep_rest:
            out.append(F.col(c))
    return df.select(*out)


def flatten_struct(schema: StructType, at: str, name: str = "") -> list[Column]:
    """Leaves of the nested structs in column ``at`` under dotted names; arrays and maps are leaves."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, StructType):
            out += flatten_struct(f.dataType, f"{at}.`{f.name}`", f"{name}{f.name}.")
        else:
            out.append(F.col(f"{at}.`{f.name}`").alias(f"{name}{f.name}"))
    return out


def flatten_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column of known schema as columns named by dotted paths."""
    parsed = df.withColumn(column, F.from_json(column, schema))
    kind = parsed.schema[column].dataType
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return parsed.select(*rest, *flatten_struct(kind, f"`{column}`"))


def json_depth(c: Column, lists: bool = False) -> Column:
    """How deep the objects (and lists) of a JSON text nest: the largest surplus of opening braces outside its strings."""
    if lists:
        c = F.translate(F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', ""), "[]", "{}")
    braces = F.regexp_replace(F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', ""), "[^{}]+", "")
    level = F.aggregate(
        F.split(braces, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda x, b: F.struct(
            (x["now"] + F.when(b == "{", 1).when(b == "}", -1).otherwise(0)).alias("now"),
            F.greatest(x["most"], x["now"] + F.when(b == "{", 1).otherwise(0)).alias("most"),
        ),
    )
    return level["most"]


def flatten_unknown(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) rows of a JSON text column whose keys aren't known, whatever its depth.

    A text is parsed once; every level is one more step of the same scan, leaves pass through. The number
    of levels is the deepest text's, taken in a pass of its own. Texts that aren't objects have no rows,
    neither has an empty object; lists are leaves, as JSON.
    """
    spark = df.sparkSession
    levels = df.agg(F.max(json_depth(F.col(column)))).first()[0] or 0
    is_object = lambda c: F.schema_of_variant(c).startswith("OBJECT")
    rows = df.select(F.col(key), F.lit(None).cast("string").alias("_path"), F.try_parse_json(column).alias("_v"))
    rows = rows.filter(is_object(F.col("_v")))
    for _ in range(levels):
        below = spark.tvf.variant_explode_outer(F.when(is_object(F.col("_v")), F.col("_v")).outer())
        found, inner = rows.lateralJoin(below), is_object(F.col("_v"))
        rows = found.filter(~inner | F.col("pos").isNotNull()).select(
            F.col(key),
            F.when(inner, F.concat_ws(".", "_path", found["key"])).otherwise(F.col("_path")).alias("_path"),
            F.when(inner, found["value"]).otherwise(F.col("_v")).alias("_v"),
        )
    return rows.select(F.col(key), F.col("_path").alias("path"), F.try_variant_get("_v", "$", "string").alias("value"))


MASKS: dict[str, Callable[[Column], Column]] = {
    "sha256": lambda c: F.sha2(c.cast("string"), 256),
    "redact": lambda c: F.lit("[REDACTED]"),
    "partial": lambda c: F.when(F.length(c.cast("string")) > 4, F.concat(F.lit("****"), F.right(c.cast("string"), F.lit(4)))).when(c.isNotNull(), F.lit("****")),
}


def mask(name: str, c: Column) -> Column:
    """sha256 and partial leave null null; redact always writes its constant. Unknown masks are errors."""
    if name not in MASKS:
        raise ValueError(f"unknown mask: {name}")
    return MASKS[name](c)


def mask_tokenize(c: Column, salt: str) -> Column:
    """A stable opaque token of a value."""
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 16)


def apply_masking(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(column, mask) rules in order; later rules see earlier results; absent columns are skipped."""
    for column, name in rules:
        if column in df.columns:
            df = df.withColumn(column, mask(name, F.col(column)))
    return df


def record_id(*keys: str) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in keys])


@arrow_udf(StringType())
def _shortest(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else repr(v) for v in x.to_pylist()], pa.string())


@arrow_udf(StringType())
def _shortest_float(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else repr(float(str(np.float32(v)))) for v in x.to_pylist()], pa.string())


def number_text(x: Column, kind: str) -> Column:
    """A double or float in its shortest digits, as SQL engines write it: 0.0001, 1e-05, 10000000.0, 1e+16, -0.0, nan, inf.

    Spark writes 1.0E-4, 1.0E7 and Infinity instead, and where Java has a digit more (2e+23 as 1.9999999999999998E23).
    """
    return (_shortest if kind == "double" else _shortest_float)(x)


def canonical_text(df: DataFrame, columns: list[str] | None = None, cents: bool = False, plain: bool = False) -> list[Column]:
    """Columns by name as text, null as null.

    Values that differ have different texts: doubles with all their digits (NaN is NaN, -0.0 is 0.0), times with
    microseconds, bytes in hex, nested values as JSON with maps in key order. cents: doubles rounded to
    hundredths and times cut to seconds, for engines that write them otherwise. plain: doubles by ``number_text``.
    """
    kinds = dict(df.dtypes)
    out = []
    for c in sorted(columns or df.columns):
        x, kind = F.col(f"`{c}`"), kinds[c]
        if plain and kind in ("double", "float"):
            x = number_text(x, kind)
        elif kind in ("double", "float"):
            x = F.when(~F.isnan(x) & (F.abs(x) < 9e16), F.round(x * 100).cast("bigint").cast("string")).otherwise(x.cast("string")) if cents else (x + 0.0).cast("string")
        elif kind.startswith("timestamp"):
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss") if cents else x.cast("string")
        elif kind == "binary":
            x = F.hex(x)
        elif kind.startswith("map<"):
            x = F.to_json(F.array_sort(F.map_entries(x)), {"ignoreNullFields": "false"})
        elif kind.startswith(("array<", "struct<", "variant")):
            x = F.to_json(x, {"ignoreNullFields": "false"})
        out.append(x.cast("string"))
    return out


def row_text(df: DataFrame, columns: list[str] | None = None, cents: bool = False, plain: bool = False) -> Column:
    """A row as one text that no other row has: each value behind its length, null as N."""
    parts = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("N")) for x in canonical_text(df, columns, cents, plain)]
    return F.concat_ws("|", *parts)


def record_checksum(df: DataFrame, columns: list[str] | None = None, cents: bool = False) -> Column:
    """SHA-256 of ``row_text``: equal only where every value is equal."""
    return F.sha2(row_text(df, columns, cents), 256)


def normalize_uuids(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns of 16-byte values (all binary ones by default) as UUID text; values of another length as plain hex."""
    for c, kind in df.dtypes:
        if c in columns if columns is not None else kind == "binary":
            x = F.lower(F.hex(F.col(f"`{c}`")))
            df = df.withColumn(c, F.regexp_replace(x, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return df


def normalize_utc(c: Column, zone: str) -> Column:
    """A local timestamp without zone as the UTC time."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c)


def base64_non_utf8(c: Column) -> Column:
    """Bytes as text where they are UTF-8, in base 64 where they are not."""
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.base64(c.cast("binary")))
