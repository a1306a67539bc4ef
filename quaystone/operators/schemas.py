"""Column profiles, type maps, coercion and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.transforms import json_depth

# The canonical type of each source type; unlisted ones are strings.
FROM_SOURCE = {
    "postgres": {
        "int64": ["integer", "bigint", "smallint", "int", "int2", "int4", "int8"],
        "bool": ["boolean"],
        "float64": ["double precision", "numeric", "real", "float4", "float8"],
        "timestamp": ["timestamp with time zone", "timestamp without time zone", "timestamptz", "date"],
        "map": ["jsonb", "json"],
        "array": ["ARRAY"],
        "blob": ["bytea"],
    },
    "mongo": {
        "int64": ["int32", "int64"],
        "bool": ["bool"],
        "float64": ["float64", "Decimal128"],
        "timestamp": ["DateTime"],
        "map": ["bson.M", "bson.D"],
        "array": ["bson.A"],
        "blob": ["[]byte"],
        "null": ["nil"],
    },
    "cassandra": {
        "int64": ["int", "bigint", "smallint", "tinyint"],
        "bool": ["boolean"],
        "float64": ["float", "double", "decimal"],
        "timestamp": ["timestamp"],
        "map": ["map"],
        "array": ["list", "set"],
        "blob": ["blob"],
    },
    "iceberg": {
        "int64": ["int", "long"],
        "bool": ["boolean"],
        "float64": ["float", "double", "decimal"],
        "timestamp": ["date", "time", "timestamp", "timestamptz"],
        "map": ["struct", "map"],
        "array": ["list"],
        "blob": ["binary", "fixed"],
    },
}
# The target type of each canonical type; others are text or string.
TO_TARGET = {
    "postgres": {"int64": "bigint", "string": "text", "bool": "boolean", "float64": "double precision", "timestamp": "timestamptz"},
    "cassandra": {"int64": "bigint", "string": "text", "bool": "boolean", "float64": "double", "timestamp": "timestamp", "map": "map<text,text>", "array": "list<text>", "blob": "blob"},
    "iceberg": {"int64": "long", "string": "string", "bool": "boolean", "float64": "double", "timestamp": "timestamptz", "blob": "binary"},
}
OTHERWISE = {"postgres": "text", "cassandra": "text", "iceberg": "string"}
# Spark's types by canonical name; maps and arrays are kept as their JSON text.
SPARK = {"int64": "bigint", "string": "string", "bool": "boolean", "float64": "double", "timestamp": "timestamp_ntz", "blob": "binary"}


def _map(spark: SparkSession, pairs: list[tuple[str, str]], names: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(pairs, names))  # a few dozen fixed rows


def canonical_types(columns: DataFrame, engine: str, source_type: str = "type") -> DataFrame:
    """Column definitions with their canonical type."""
    pairs = [(t, c) for c, ts in FROM_SOURCE[engine].items() for t in ts]
    m = _map(columns.sparkSession, pairs, "_t string, _c string")
    plain = F.regexp_extract(source_type, r"^([^(<]*[^(<\s])", 1)  # decimal(10,2) is a decimal, list<int> a list
    return columns.join(m, plain == m["_t"], "left").withColumn("canonical", F.coalesce("_c", F.lit("string"))).drop("_t", "_c")


def target_types(columns: DataFrame, engine: str, canonical: str = "canonical") -> DataFrame:
    m = _map(columns.sparkSession, list(TO_TARGET[engine].items()), "_c string, _t string")
    return columns.join(m, columns[canonical] == m["_c"], "left").withColumn("target_type", F.coalesce("_t", F.lit(OTHERWISE[engine]))).drop("_c", "_t")


def canonical_of(df: DataFrame) -> list[tuple[str, str]]:
    """(column, canonical type) of a DataFrame's schema."""
    names = {"bigint": "int64", "int": "int64", "smallint": "int64", "tinyint": "int64", "double": "float64", "float": "float64", "boolean": "bool", "binary": "blob", "void": "null"}
    out = []
    for c, t in df.dtypes:
        kind = t.split("<")[0].split("(")[0]
        out.append((c, names.get(kind, "float64" if kind == "decimal" else "timestamp" if kind.startswith(("timestamp", "date")) else "map" if kind in ("map", "struct", "variant") else "array" if kind == "array" else "string")))
    return out


def profile_columns(df: DataFrame, exact: bool = False, error: float = 0.01) -> DataFrame:
    """One row for each column: canonical type, nulls, distinct values, bounds, uniqueness; one pass.

    Distinct values are estimated with relative standard deviation ``error``, so the pass has no shuffle of values; a column whose
    estimate reaches the row count within three such deviations may be unique, and its repeats are looked for
    in a second pass: ``is_unique`` is exact. exact: distinct values are counted, which expands every row once for each
    column. Columns with maps have no order and no equality: their values are told apart by JSON and have no bounds.
    """
    kinds = dict(df.dtypes)
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        comparable = _comparable(x, kinds[c])
        distinct = F.count_distinct(comparable) if exact else F.approx_count_distinct(comparable, error)
        ends = [F.lit(None).cast("string") if comparable is not x else f(x).cast("string") for f in (F.min, F.max)]
        aggs += [F.count_if(x.isNull()).alias(f"n{i}"), distinct.alias(f"d{i}"), ends[0].alias(f"l{i}"), ends[1].alias(f"h{i}")]
    one, slack = df.agg(*aggs), 0.0 if exact else 3 * error
    repeated: set[str] = set()
    if not exact:
        first = one.first()
        one = df.sparkSession.createDataFrame([first], one.schema)
        for i, c in enumerate(df.columns):
            if first[f"n{i}"] == 0 and first[f"d{i}"] >= first["_n"] * (1 - slack) and not df.groupBy(_comparable(F.col(f"`{c}`"), kinds[c]).alias("x")).count().filter("count > 1").isEmpty():
                repeated.add(c)
    rows = []
    for i, (c, t) in enumerate(canonical_of(df)):
        nulls, distinct = F.col(f"n{i}"), F.col(f"d{i}")
        unique = (nulls == 0) & (distinct >= F.col("_n") * (1 - slack)) & F.lit(c not in repeated)
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("canonical"), nulls.alias("n_null"), distinct.alias("n_distinct"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), unique.alias("is_unique")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _comparable(x: Column, kind: str) -> Column:
    """A column that can be grouped and compared: values with maps or variants as JSON, maps in key order."""
    if kind.startswith("map<"):
        return F.to_json(F.array_sort(F.map_entries(x)), {"ignoreNullFields": "false"}) if "map<" not in kind[4:] else F.to_json(x, {"ignoreNullFields": "false"})
    return F.to_json(x, {"ignoreNullFields": "false"}) if "map<" in kind or "variant" in kind else x


def infer_document_schema(df: DataFrame, column: str) -> DataFrame:
    """Top-level fields of JSON documents: how often, and the kinds of value; over all rows.

    A document is parsed once; fields may have any name. What is no object has no fields.
    """
    parsed = df.select(F.try_parse_json(column).alias("_d")).filter(F.schema_of_variant("_d").startswith("OBJECT"))
    fields = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_d").outer())).select(F.col("key").alias("field"), F.schema_of_variant("value").alias("kind"))
    return fields.groupBy("field").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def document_paths(df: DataFrame, column: str) -> DataFrame:
    """``df``'s other columns with (path, kind) for every value in its JSON documents, at any depth; one pass after the one that finds the depth.

    Keys are joined by dots, elements of lists are ``[]``; kinds are OBJECT, ARRAY, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN and VOID (null).
    Texts that aren't objects have no paths.
    """
    levels = df.agg(F.max(json_depth(F.col(column), lists=True))).first()[0] or 0
    rest = [f"`{c}`" for c in df.columns if c != column]
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    rows = df.select(*rest, F.lit("").alias("path"), F.lit(0).alias("_depth"), F.try_parse_json(column).alias("_v"))
    rows = rows.filter(kind(F.col("_v")) == "OBJECT")
    for depth in range(levels):
        # a container goes on as itself and, in a second row, as its parts
        opens = (F.col("_depth") == depth) & kind(F.col("_v")).isin("OBJECT", "ARRAY")
        both = rows.select("*", F.explode(F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_open"))
        parts = both.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.when(F.col("_open"), F.col("_v")).outer()))
        step = F.when(parts["key"].isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", parts["key"]).otherwise(F.concat("path", F.lit("."), parts["key"]))
        parts = parts.filter(~F.col("_open") | F.col("pos").isNotNull())
        rows = parts.select(*rest, F.when(F.col("_open"), step).otherwise(F.col("path")).alias("path"), F.when(F.col("_open"), depth + 1).otherwise(F.col("_depth")).alias("_depth"), F.when(F.col("_open"), parts["value"]).otherwise(F.col("_v")).alias("_v"))
    return rows.filter("path != ''").select(*rest, "path", kind(F.col("_v")).alias("kind"))


def infer_nested_schema(df: DataFrame, column: str) -> DataFrame:
    """Every path of JSON documents: how often it comes, its kinds, and whether they conflict (more than one beside null); over all rows."""
    each = document_paths(df.select(column), column).groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("k"))
    return each.select("path", "n", F.array_join("k", ",").alias("kinds"), (F.size(F.array_except("k", F.array(F.lit("VOID")))) > 1).alias("conflict"))


def type_deviation(df: DataFrame, key: str, column: str, expected: dict[str, str]) -> DataFrame:
    """Documents that differ from the expected kinds of paths: which are missing, extra or of another kind (null fits every kind).

    A document without paths (null, no object) misses all. Rows of one key are judged together; a path inside
    lists counts as there once some element has it.
    """
    want = F.create_map(*[F.lit(x) for p in expected.items() for x in p]) if expected else F.create_map().cast("map<string,string>")
    seen = document_paths(df.select(key, column), column).groupBy(key).agg(F.collect_set(F.struct("path", "kind")).alias("s"))
    all_ = df.select(key).distinct().join(seen.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left")
    s = F.coalesce("s", F.array().cast("array<struct<path:string,kind:string>>"))
    paths = F.transform(s, lambda x: x["path"])
    wrong = F.transform(F.filter(s, lambda x: (x["kind"] != "VOID") & (F.element_at(want, x["path"]) != x["kind"])), lambda x: F.concat(x["path"], F.lit(":"), x["kind"]))
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    out = all_.select(key, text(F.array_except(F.map_keys(want), paths)).alias("missing"), text(F.array_except(paths, F.map_keys(want))).alias("extra"), text(wrong).alias("mistyped"))
    return out.filter("missing != '' or extra != '' or mistyped != ''")


def schema_deviation(df: DataFrame, key: str, column: str, expected: list[str]) -> DataFrame:
    """Documents whose keys aren't the expected ones, with what is missing and what is extra."""
    keys, want = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in expected])
    out = df.select(key, F.array_join(F.array_sort(F.array_except(want, keys)), ",").alias("missing"), F.array_join(F.array_sort(F.array_except(keys, want)), ",").alias("extra"))
    return out.filter("missing != '' or extra != ''")


def _coerced(x: Column, kind: str, to: str) -> Column:
    """A column of Spark type ``kind`` as canonical type ``to``; null where it can't be."""
    if to == "int64" and kind in ("double", "float"):
        return x.try_cast("double").try_cast("bigint")
    if to == "timestamp" and kind in ("bigint", "int", "smallint", "tinyint"):
        # whole numbers are microseconds since 1970; out of range is an error of the row
        micros = x.cast("bigint")
        fits = (micros > -62135596800000000) & (micros < 253402300800000000)
        return F.when(fits, F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(F.when(fits, micros)).cast("timestamp_ntz")))
    if to not in SPARK:  # map, array and other kinds are kept as text
        return F.to_json(x, {"ignoreNullFields": "false"}) if kind.startswith(("map<", "array<", "struct<", "variant")) else x.cast("string")
    if kind.startswith(("map<", "array<", "struct<", "variant")):
        return F.to_json(x, {"ignoreNullFields": "false"}) if to == "string" else F.lit(None).cast(SPARK[to])
    if kind == "binary" and to not in ("string", "blob"):
        return F.lit(None).cast(SPARK[to])
    if to == "blob":
        return x.cast("string").cast("binary") if kind != "binary" else x
    return x.try_cast(SPARK[to])


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Spark types that become a canonical type strictly; types that aren't listed take any value as text.
STRICT = {
    "int64": NUMBERS,
    "float64": (*NUMBERS, "decimal"),
    "bool": ("boolean",),
    "timestamp": ("timestamp", "timestamp_ntz", "date", "tinyint", "smallint", "int", "bigint"),
    "blob": ("binary", "string"),
}


def coerce_to_schema(df: DataFrame, kinds: dict[str, str], strict: bool = True) -> DataFrame:
    """Each named column as a canonical type; ``_errors`` lists those that couldn't be.

    Null stays null and is no error. Whole numbers become timestamps as microseconds; maps, arrays and
    unknown kinds become text, nested values as JSON. strict: only numbers become numbers (fractions are cut off), only booleans
    booleans, only times and whole numbers timestamps; otherwise texts that read as such a value do as well.
    """
    errors, out = [], []
    types = dict(df.dtypes)
    for c in df.columns:
        x = F.col(f"`{c}`")
        if c not in kinds:
            out.append(x)
            continue
        v = _coerced(x, types[c], kinds[c])
        if strict and types[c].split("(")[0] not in STRICT.get(kinds[c], (types[c].split("(")[0],)):
            v = F.lit(None).cast(SPARK[kinds[c]])
        out.append(v.alias(c))
        errors.append(F.when(x.isNotNull() & v.isNull(), F.lit(f"{c}: not {kinds[c]}")))
    return df.select(*out, F.array_compact(F.array(*errors)).alias("_errors") if errors else F.array().cast("array<string>").alias("_errors"))


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their errors; read the frame once by persisting it when both are written."""
    return df.filter(F.size("_errors") == 0).drop("_errors"), df.filter(F.size("_errors") > 0)


def allowed_values_check(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value isn't allowed; null is allowed where the column is nullable."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def key_uniqueness_check(df: DataFrame, *keys: str) -> DataFrame:
    """One row: keys that occur more than once, rows they have, rows with a null in the key."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    each = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("null_key", null)
    return each.agg(F.count_if((F.col("n") > 1) & ~F.col("null_key")).alias("n_repeated_keys"), F.coalesce(F.sum(F.when((F.col("n") > 1) & ~F.col("null_key"), F.col("n"))), F.lit(0)).cast("bigint").alias("n_rows_of_them"), F.coalesce(F.sum(F.when(F.col("null_key"), F.col("n"))), F.lit(0)).cast("bigint").alias("n_null_keys"))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Added, removed and changed columns between two schemas (as DataFrames of column, type)."""
    both = a.select("column", F.col("type").alias("old")).join(b.select("column", F.col("type").alias("new")), "column", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("change", change).filter("change is not null")


def schema_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def errors_of(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, for ``isolate_bad_rows``: a check that is null fails too."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
