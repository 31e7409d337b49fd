"""Feature-service metadata: join keys, request fields, typed arguments.

Tables:
  refs(service, view, position, override map<string,string>)    feature references
  entities(view, key, key_pos, type)                           join keys of a view
  sources(view, source_view, source_pos, override map)          view sources (realtime views)
  request(service, schema map<string,string>)                  request fields
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared feature types and their Spark types (leaf names).
TYPE_MAP = [("Int64", "bigint"), ("Int32", "int"), ("Float64", "double"), ("Float32", "float"),
            ("String", "string"), ("Bool", "boolean"), ("Timestamp", "timestamp")]


def spark_type(decl) -> Column:
    """Declared type -> Spark type string: leaves by TYPE_MAP, Array(x) ->
    array<x>, Map(k, v) -> map<k,v>, Struct -> struct; null when any part
    is unknown (the caller routes those to rejects)."""
    c = F.col(decl) if isinstance(decl, str) else decl
    t = c
    for src, dst in TYPE_MAP:
        t = F.regexp_replace(t, f"\\b{src}\\b", dst)
    t = F.regexp_replace(t, "\\bArray\\(", "array<")
    t = F.regexp_replace(t, "\\bMap\\(", "map<")
    t = F.regexp_replace(t, "\\bStruct\\b(\\([^)]*\\))?", "struct")
    t = F.regexp_replace(F.regexp_replace(t, "\\)", ">"), ",\\s*", ",")
    known = t.rlike("^(bigint|int|double|float|string|boolean|timestamp|struct|array<|map<|[<>,])+$")
    return F.when(known, t)


def declared_type(decl: str) -> T.DataType:
    """Spark type of a declared type: leaves by TYPE_MAP, Array(x), Map(k, v)
    of any depth; Struct, with or without fields, is a map of any values, and
    an unknown name any value (a variant)."""
    decl = decl.strip()
    name, _, inner = decl.partition("(")
    if decl.endswith(")") and name in ("Array", "Map"):
        parts, depth = [""], 0
        for c in inner[:-1]:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append("")
            else:
                parts[-1] += c
        if name == "Array" and len(parts) == 1:
            return T.ArrayType(declared_type(parts[0]))
        if name == "Map" and len(parts) == 2:
            return T.MapType(declared_type(parts[0]), declared_type(parts[1]))
    if name == "Struct":
        return T.MapType(T.StringType(), T.VariantType())
    leaf = dict(TYPE_MAP).get(decl)
    return T.DataType.fromDDL(leaf) if leaf else T.VariantType()


def _typed(v: Column, want: T.DataType) -> tuple[Column, Column]:
    """(value, whether it fits) of a variant as type ``want``."""
    kind = F.schema_of_variant(v)
    if isinstance(want, T.VariantType):
        return v, F.lit(True)
    if isinstance(want, T.ArrayType):
        items = F.try_variant_get(v, "$", "array<variant>")
        return (F.transform(items, lambda x: _typed(x, want.elementType)[0]),
                kind.startswith("ARRAY") & F.forall(items, lambda x: _typed(x, want.elementType)[1]))
    if isinstance(want, T.MapType):
        items = F.try_variant_get(v, "$", "map<string,variant>")
        value = F.transform_values(items, lambda _, x: _typed(x, want.valueType)[0])
        fits = F.forall(F.map_values(items), lambda x: _typed(x, want.valueType)[1])
        if not isinstance(want.keyType, T.StringType):
            # a key as a JSON string: numbers and truth values are read from their text
            key = want.keyType.simpleString()
            fits = fits & F.forall(F.map_keys(items), lambda k: k.try_cast(key).isNotNull())
            value = F.map_from_entries(F.transform(F.map_entries(value), lambda e: F.struct(
                e["key"].try_cast(key).alias("key"), e["value"].alias("value"))))
        return value, kind.startswith("OBJECT") & fits
    value = F.try_variant_get(v, "$", want.simpleString())
    if isinstance(want, T.StringType):
        fits = kind == "STRING"
    elif isinstance(want, T.BooleanType):
        fits = kind == "BOOLEAN"
    elif isinstance(want, (T.LongType, T.IntegerType)):
        number = F.try_variant_get(v, "$", "double")
        fits = (kind != "BOOLEAN") & (number == F.floor(number))
    else:
        fits = kind != "BOOLEAN"
    return value, F.coalesce(fits, F.lit(False)) & value.isNotNull()


def typed_requests(requests: DataFrame, schema: dict[str, str], body: str = "body",
                   applies: dict[str, Column] | None = None) -> DataFrame:
    """``requests`` with a typed column per field of ``schema`` (name ->
    declared type) instead of the JSON text ``body``, and ``rejects``, an
    array of (field, reason) that is empty for a valid row (C16).

    A field must be there and fit its type: whole numbers for integers (also
    as text), numbers or their text for floats, texts, truth values, time
    texts; every element of arrays and maps must fit. A field that does not
    is null and rejected ("missing" or "not <type>"); a JSON null does not fit.
    ``applies`` names the rows that have a field at all; elsewhere it is null
    without a reject. A body that is null or no JSON object is one reject of
    the field "". Fields that are not declared are ignored. A declared field
    may not have the name of another column of ``requests``."""
    taken = {c.lower() for c in requests.columns if c != body} | {"rejects"}
    clash = sorted(n for n in schema if n.lower() in taken)
    if clash:
        raise ValueError(f"fields clash with columns: {', '.join(clash)}")
    spark_types = {n: declared_type(d) for n, d in schema.items()}
    parsed = requests.withColumn("__m", F.from_json(F.col(f"`{body}`"), "map<string,variant>"))
    values, rejects = [], []
    ok_row = F.col("__m").isNotNull()
    for n, want in spark_types.items():
        v = F.element_at("__m", F.lit(n))
        value, fits = _typed(v, want)
        asked = ok_row & F.coalesce((applies or {}).get(n, F.lit(True)), F.lit(False))
        fits = F.coalesce(fits, F.lit(False))
        reason = F.when(asked & v.isNull(), F.lit("missing")).when(asked & ~fits, F.lit(f"not {schema[n]}"))
        values.append(F.when(asked & v.isNotNull() & fits, value).alias(n))
        rejects.append(F.struct(F.lit(n).alias("field"), reason.alias("reason")))
    whole = F.struct(F.lit("").alias("field"), F.when(~ok_row, F.lit("not a JSON object")).alias("reason"))
    found = F.filter(F.array(whole, *rejects), lambda r: r["reason"].isNotNull())
    return parsed.select(*[F.col(f"`{c}`") for c in requests.columns if c != body], *values, found.alias("rejects"))


def view_keys(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Join keys a reference contributes directly: the view's entity keys,
    renamed through the reference's override map (E6)."""
    return (refs.join(entities, "view")
            .select("service", "position", F.lit(0).alias("stage"), F.lit(0).alias("source_pos"), "key_pos",
                    F.coalesce(F.element_at("override", F.col("key")), F.col("key")).alias("name"), "type"))


def source_keys(refs: DataFrame, sources: DataFrame, entities: DataFrame) -> DataFrame:
    """Keys of the views a (realtime) view reads: the source's own override
    first, then the reference's override (E7). Request sources have none."""
    s = sources.join(entities.withColumnRenamed("view", "source_view"), "source_view")
    s = s.withColumn("k1", F.coalesce(F.element_at(F.col("source_override"), F.col("key")), F.col("key")))
    return (refs.join(s, "view")
            .select("service", "position", F.lit(1).alias("stage"), "source_pos", "key_pos",
                    F.coalesce(F.element_at("override", F.col("k1")), F.col("k1")).alias("name"), "type"))


def service_join_keys(refs: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """(service, name, type): every join key a service needs; when two
    entries give the same final name, the later one (reference order, direct
    keys before source keys) decides the type (E7)."""
    allk = view_keys(refs, entities).unionByName(source_keys(refs, sources, entities))
    order = F.struct("position", "stage", "source_pos", "key_pos")
    return allk.groupBy("service", "name").agg(F.max_by("type", order).alias("type"))


def request_fields(request: DataFrame) -> DataFrame:
    """(service, name, type) from each service's request schema."""
    return request.select("service", F.explode("schema").alias("name", "type"))


def service_descriptions(services: DataFrame, refs: DataFrame, features: DataFrame) -> DataFrame:
    """Tool text per service: name, description and its features in
    reference order joined by ', ' (C20)."""
    f = refs.join(features, "view").groupBy("service").agg(
        F.array_sort(F.collect_list(F.struct("position", "feature_pos", "feature"))).alias("fs"))
    names = F.array_join(F.transform("fs", lambda x: x["feature"]), ", ")
    d = services.join(f, "service", "left")
    text = F.concat(F.lit("Call FeatureService "), F.col("service"), F.lit(".\nDescription: "),
                    F.coalesce(F.col("description"), F.lit("")),
                    F.when(F.size("fs") > 0, F.concat(F.lit("\nFeatures: "), names)).otherwise(F.lit("")))
    return d.select("service", text.alias("description"))
