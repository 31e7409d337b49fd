"""Feature-service metadata queries (FX7: a service per supplier over
nation and region views, deterministic overrides, realtime views with
sources)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.services import (TYPE_MAP, request_fields, service_descriptions, service_join_keys,
                                        spark_type, typed_requests)
from tessera.plans.registry import register
from tessera.sources.tables import read_table

def _empty_map():
    return F.create_map().cast("map<string,string>")


def fx7(spark, sf_dir):
    """One feature service per supplier; it references the views of its
    nation and of its region. Views carry entity keys; nation views of
    some nations are realtime views reading their region's view; overrides
    and request fields follow fixed rules on the keys."""
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    sk, nk, rk = F.col("s_suppkey"), F.col("n_nationkey"), F.col("r_regionkey")
    svc = F.concat(F.lit("svc_"), sk.cast("string"))
    services = sup.select(svc.alias("service"), F.concat(F.lit("Features for supplier "), sk.cast("string"))
                          .alias("description"), "s_suppkey", "s_nationkey")
    sn = sup.join(n, sup["s_nationkey"] == n["n_nationkey"])
    nview = F.concat(F.lit("fv_n"), F.col("n_nationkey").cast("string"))
    rview = F.concat(F.lit("fv_r"), F.col("n_regionkey").cast("string"))
    ovr = F.when(sk % 4 == 1, F.create_map(F.lit("user_id"), F.lit("customer_id"))).otherwise(_empty_map())
    refs = (sn.select(svc.alias("service"), nview.alias("view"), F.lit(0).alias("position"), ovr.alias("override"))
            .unionByName(sn.select(svc.alias("service"), rview.alias("view"), F.lit(1).alias("position"),
                                   ovr.alias("override"))))
    nv = F.concat(F.lit("fv_n"), nk.cast("string"))
    rv = F.concat(F.lit("fv_r"), rk.cast("string"))
    entities = (n.select(nv.alias("view"), F.lit("user_id").alias("key"), F.lit(0).alias("key_pos"),
                         F.lit("Int64").alias("type"))
                .unionByName(n.filter(nk % 3 == 0).select(nv.alias("view"), F.lit("merchant_id").alias("key"),
                                                          F.lit(1).alias("key_pos"), F.lit("String").alias("type")))
                .unionByName(r.select(rv.alias("view"), F.lit("user_id").alias("key"), F.lit(0).alias("key_pos"),
                                      F.lit("Int64").alias("type")))
                .unionByName(r.select(rv.alias("view"), F.lit("event_day").alias("key"), F.lit(1).alias("key_pos"),
                                      F.lit("Timestamp").alias("type"))))
    sources = n.filter(nk % 6 == 2).select(
        nv.alias("view"), F.concat(F.lit("fv_r"), F.col("n_regionkey").cast("string")).alias("source_view"),
        F.lit(0).alias("source_pos"),
        F.when(nk % 12 == 2, F.create_map(F.lit("user_id"), F.lit("buyer_id"))).otherwise(_empty_map())
        .alias("source_override"))
    views = n.select(nv.alias("view")).unionByName(r.select(rv.alias("view")))
    features = (views.select("view", F.lit(0).alias("feature_pos"), F.concat("view", F.lit("__count")).alias("feature"))
                .unionByName(views.select("view", F.lit(1).alias("feature_pos"),
                                          F.concat("view", F.lit("__sum")).alias("feature"))))
    schema = F.map_concat(
        F.create_map(F.lit("amount"), F.lit("Float64")),
        F.when(sk % 2 == 0, F.create_map(F.lit("query_embedding"), F.lit("Array(Float32)"))).otherwise(_empty_map()),
        F.when(sk % 5 == 1, F.create_map(F.lit("tags"), F.lit("Map(String, Int64)"))).otherwise(_empty_map()))
    request = services.select("service", schema.alias("schema"))
    return services.select("service", "description"), refs, entities, sources, features, request


FX7_SQL = """services AS (SELECT 'svc_' || CAST(s_suppkey AS VARCHAR) AS service,
                     'Features for supplier ' || CAST(s_suppkey AS VARCHAR) AS description, s_suppkey, s_nationkey
              FROM supplier),
sn AS (SELECT s.*, n.n_regionkey FROM services s JOIN nation n ON s.s_nationkey = n.n_nationkey),
refs AS (SELECT service, 'fv_n' || CAST(s_nationkey AS VARCHAR) AS view, 0 AS position, s_suppkey FROM sn
         UNION ALL SELECT service, 'fv_r' || CAST(n_regionkey AS VARCHAR), 1, s_suppkey FROM sn),
ref_ovr AS (SELECT service, 'user_id' AS from_key, 'customer_id' AS to_key FROM services WHERE s_suppkey % 4 = 1),
entities AS (SELECT 'fv_n' || CAST(n_nationkey AS VARCHAR) AS view, 'user_id' AS key, 0 AS key_pos, 'Int64' AS type FROM nation
             UNION ALL SELECT 'fv_n' || CAST(n_nationkey AS VARCHAR), 'merchant_id', 1, 'String' FROM nation WHERE n_nationkey % 3 = 0
             UNION ALL SELECT 'fv_r' || CAST(r_regionkey AS VARCHAR), 'user_id', 0, 'Int64' FROM region
             UNION ALL SELECT 'fv_r' || CAST(r_regionkey AS VARCHAR), 'event_day', 1, 'Timestamp' FROM region),
sources AS (SELECT 'fv_n' || CAST(n_nationkey AS VARCHAR) AS view, 'fv_r' || CAST(n_regionkey AS VARCHAR) AS source_view,
                   0 AS source_pos FROM nation WHERE n_nationkey % 6 = 2),
src_ovr AS (SELECT 'fv_n' || CAST(n_nationkey AS VARCHAR) AS view, 'user_id' AS from_key, 'buyer_id' AS to_key
            FROM nation WHERE n_nationkey % 12 = 2),
views AS (SELECT 'fv_n' || CAST(n_nationkey AS VARCHAR) AS view FROM nation
          UNION ALL SELECT 'fv_r' || CAST(r_regionkey AS VARCHAR) FROM region),
features AS (SELECT view, 0 AS feature_pos, view || '__count' AS feature FROM views
             UNION ALL SELECT view, 1, view || '__sum' FROM views),
request AS (SELECT service, 'amount' AS name, 'Float64' AS type FROM services
            UNION ALL SELECT service, 'query_embedding', 'Array(Float32)' FROM services WHERE s_suppkey % 2 = 0
            UNION ALL SELECT service, 'tags', 'Map(String, Int64)' FROM services WHERE s_suppkey % 5 = 1)"""


def _type_sql(x: str) -> str:
    t = x
    for src, dst in TYPE_MAP:
        t = f"regexp_replace({t}, '\\b{src}\\b', '{dst}', 'g')"
    t = f"regexp_replace({t}, '\\bArray\\(', 'array<', 'g')"
    t = f"regexp_replace({t}, '\\bMap\\(', 'map<', 'g')"
    t = f"regexp_replace({t}, '\\bStruct\\b(\\([^)]*\\))?', 'struct', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '\\)', '>', 'g'), ',\\s*', ',', 'g')"
    return (f"CASE WHEN regexp_full_match({t}, '(bigint|int|double|float|string|boolean|timestamp|struct|array<|map<|[<>,])+') "
            f"THEN {t} END")


@register("service_join_keys", sql=f"""WITH {FX7_SQL},
direct AS (SELECT r.service, r.position, 0 AS stage, 0 AS source_pos, e.key_pos,
                  coalesce(o.to_key, e.key) AS name, e.type
           FROM refs r JOIN entities e USING (view)
           LEFT JOIN ref_ovr o ON o.service = r.service AND o.from_key = e.key),
src AS (SELECT r.service, r.position, 1 AS stage, s.source_pos, e.key_pos,
               coalesce(o.to_key, coalesce(so.to_key, e.key)) AS name, e.type
        FROM refs r JOIN sources s USING (view)
        JOIN entities e ON e.view = s.source_view
        LEFT JOIN src_ovr so ON so.view = r.view AND so.from_key = e.key
        LEFT JOIN ref_ovr o ON o.service = r.service AND o.from_key = coalesce(so.to_key, e.key)),
keys AS (SELECT service, name,
                arg_max(type, position * 1000000 + stage * 10000 + source_pos * 100 + key_pos) AS type
         FROM (SELECT * FROM direct UNION ALL SELECT * FROM src) GROUP BY service, name),
fields AS (SELECT service, name, 'join_key' AS field_kind, type FROM keys
           UNION ALL SELECT service, name, 'request', type FROM request)
SELECT service, name AS field_name, field_kind, type AS source_type, {_type_sql('type')} AS spark_type FROM fields""")
def service_join_keys_q(spark, sf_dir):
    """Join keys and request fields of every feature service, with their
    Spark types: overrides, source views, later-wins (E6-E8, C16)."""
    services, refs, entities, sources, features, request = fx7(spark, sf_dir)
    keys = service_join_keys(refs, entities, sources).withColumn("field_kind", F.lit("join_key"))
    req = request_fields(request).withColumn("field_kind", F.lit("request"))
    fields = keys.unionByName(req)
    return fields.select("service", F.col("name").alias("field_name"), "field_kind",
                         F.col("type").alias("source_type"), spark_type("type").alias("spark_type"))


@register("service_catalog", sql=f"""WITH {FX7_SQL},
f AS (SELECT r.service, string_agg(ft.feature, ', ' ORDER BY r.position, ft.feature_pos) AS names
      FROM refs r JOIN features ft USING (view) GROUP BY r.service)
SELECT s.service, 'Call FeatureService ' || s.service || '.' || chr(10) || 'Description: ' || s.description
       || CASE WHEN f.names IS NOT NULL THEN chr(10) || 'Features: ' || f.names ELSE '' END AS description
FROM services s LEFT JOIN f USING (service)""")
def service_catalog(spark, sf_dir):
    """One description text per feature service (C20)."""
    services, refs, _, _, features, _ = fx7(spark, sf_dir)
    return service_descriptions(services, refs, features)


# One request per order to the service of its first line's supplier: the
# declared fields as JSON, some missing, of a wrong type or malformed.
REQUEST_SCHEMA = {"amount": "Float64", "query_embedding": "Array(Float32)", "tags": "Map(String, Int64)"}


def order_requests(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    rows = o.join(li.where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    body = F.concat_ws(
        ", ",
        F.when(k % 11 != 0, F.concat(F.lit('"amount": '), F.when(k % 7 == 0, F.lit('"n/a"')).otherwise(
            F.col("o_totalprice").cast("string")))),
        F.concat(F.lit('"query_embedding": ['), F.col("o_custkey").cast("string"),
                 F.when(k % 13 == 0, F.lit(', "x"]')).otherwise(F.lit(", 0.5]"))),
        F.concat(F.lit('"tags": {"lines": '), F.col("l_quantity").cast("int").cast("string"),
                 F.when(k % 17 == 0, F.lit(', "share": 1.5}')).otherwise(F.lit("}"))))
    return rows.select(k.alias("request_id"), F.col("l_suppkey").alias("service_no"),
                       F.when(k % 19 == 0, F.lit("oops")).otherwise(F.concat(F.lit("{"), body, F.lit("}"))).alias("body"))


_REQ_SQL = """r AS (SELECT o_orderkey AS request_id, l_suppkey AS service_no,
       CASE WHEN o_orderkey % 19 = 0 THEN 'oops' ELSE '{' || concat_ws(', ',
         CASE WHEN o_orderkey % 11 <> 0 THEN '"amount": ' ||
           CASE WHEN o_orderkey % 7 = 0 THEN '"n/a"' ELSE CAST(o_totalprice AS VARCHAR) END END,
         '"query_embedding": [' || o_custkey || CASE WHEN o_orderkey % 13 = 0 THEN ', "x"]' ELSE ', 0.5]' END,
         '"tags": {"lines": ' || CAST(l_quantity AS INTEGER) ||
           CASE WHEN o_orderkey % 17 = 0 THEN ', "share": 1.5}' ELSE '}' END) || '}' END AS body
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1),
j AS (SELECT request_id, service_no, CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT'
                                          THEN CAST(body AS JSON) END AS b FROM r),
p AS (SELECT *, b IS NOT NULL AS ok, service_no % 2 = 0 AS has_e, service_no % 5 = 1 AS has_t,
             json_extract(b, '$.amount') AS a, json_extract(b, '$.query_embedding') AS e, json_extract(b, '$.tags') AS g FROM j),
t AS (SELECT *, TRY_CAST(json_extract_string(b, '$.amount') AS DOUBLE) AS av, CASE WHEN list_count(TRY_CAST(e AS FLOAT[])) = len(TRY_CAST(e AS FLOAT[])) THEN TRY_CAST(e AS FLOAT[]) END AS ev,
             list_bool_and(list_transform(json_keys(g), lambda x: TRY_CAST(json_extract(g, '$."' || x || '"') AS DOUBLE)
                                          = floor(TRY_CAST(json_extract(g, '$."' || x || '"') AS DOUBLE)))) AS g_ok FROM p)"""


@register("request_rows", sql=f"""WITH {_REQ_SQL}
SELECT request_id, service_no, round(av, 2) AS amount, CASE WHEN has_e AND ev IS NOT NULL THEN len(ev) END AS n_embedding,
       CASE WHEN has_e THEN CAST(ev[1] AS DOUBLE) END AS first_value,
       CASE WHEN has_t THEN CAST(json_extract(g, '$.lines') AS BIGINT) END AS n_lines
FROM t WHERE ok AND av IS NOT NULL AND (NOT has_e OR ev IS NOT NULL) AND (NOT has_t OR g_ok)""")
def request_rows(spark, sf_dir):
    """Typed rows of the valid requests; which fields a request has follows
    its service's schema (C16)."""
    s = F.col("service_no")
    out = typed_requests(order_requests(spark, sf_dir), REQUEST_SCHEMA,
                         applies={"query_embedding": s % 2 == 0, "tags": s % 5 == 1})
    return out.where(F.size("rejects") == 0).select(
        "request_id", "service_no", F.round("amount", 2).alias("amount"),
        F.when(F.col("query_embedding").isNotNull(), F.size("query_embedding")).cast("long").alias("n_embedding"),
        F.get("query_embedding", F.lit(0)).cast("double").alias("first_value"),
        F.try_element_at("tags", F.lit("lines")).alias("n_lines"))


@register("request_rejects", sql=f"""WITH {_REQ_SQL}
SELECT request_id, '' AS field, 'not a JSON object' AS reason FROM t WHERE NOT ok
UNION ALL SELECT request_id, 'amount', CASE WHEN a IS NULL THEN 'missing' ELSE 'not Float64' END FROM t
  WHERE ok AND av IS NULL
UNION ALL SELECT request_id, 'query_embedding', 'not Array(Float32)' FROM t WHERE ok AND has_e AND ev IS NULL
UNION ALL SELECT request_id, 'tags', 'not Map(String, Int64)' FROM t WHERE ok AND has_t AND NOT g_ok""")
def request_rejects(spark, sf_dir):
    """The fields of requests that are missing or do not fit their declared
    type, with the reason (C16)."""
    s = F.col("service_no")
    out = typed_requests(order_requests(spark, sf_dir), REQUEST_SCHEMA,
                         applies={"query_embedding": s % 2 == 0, "tags": s % 5 == 1})
    return out.select("request_id", F.explode("rejects").alias("r")).select("request_id", "r.field", "r.reason")
