"""Feature-engineering queries over ``events`` and the order schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import cosine, haversine_km
from tessera.operators.features import (WindowAgg, asof_join, latest_per_key, range_window_features,
                                        session_starts, tiled_window_features, time_tiles, ts_micros)
from tessera.plans.registry import register
from tessera.session import materialize, shuffles_of
from tessera.sources.tables import read_table

H, D = 3600, 86400
E_US = "epoch_us"


def events(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "events", *(cols or ("event_id", "ts", "user_id", "event_type", "value",
                                                          "props")))


def _us(sec: int) -> str:
    return str(sec * 1_000_000)


ORACLE_WINDOW_FEATURES = f"""WITH e AS (SELECT event_id, user_id, ts, event_type, value, {E_US}(ts) AS t FROM events)
SELECT a.event_id, a.user_id, a.ts,
       round(sum(CASE WHEN b.t > a.t - {_us(H)} THEN b.value END), 6) AS amt_sum_1h,
       max(CASE WHEN b.t > a.t - {_us(D)} THEN b.value END) AS amt_max_1d,
       min(CASE WHEN b.t > a.t - {_us(3 * D)} THEN b.value END) AS amt_min_3d,
       count(*) FILTER (WHERE b.t > a.t - {_us(7 * D)} AND b.event_type = 'signup') AS signups_7d,
       count(*) FILTER (WHERE b.event_type = 'signup') AS signups_30d
FROM e a JOIN e b ON a.user_id = b.user_id AND b.t <= a.t AND b.t > a.t - {_us(30 * D)}
GROUP BY a.event_id, a.user_id, a.ts"""


@register("window_features", sql=ORACLE_WINDOW_FEATURES)
def window_features(spark, sf_dir):
    """Sliding per-user aggregates over (t - w, t]: sum 1 h, max 1 d, min
    3 d, signup counts 7 d / 30 d (H7, H10)."""
    ev = events(spark, sf_dir, "event_id", "user_id", "ts", "event_type", "value")
    aggs = [WindowAgg("amt_sum_1h", "sum", "value", H), WindowAgg("amt_max_1d", "max", "value", D),
            WindowAgg("amt_min_3d", "min", "value", 3 * D),
            WindowAgg("signups_7d", "count_if", F.col("event_type") == "signup", 7 * D),
            WindowAgg("signups_30d", "count_if", F.col("event_type") == "signup", 30 * D)]
    out = range_window_features(ev, "user_id", "ts", aggs)
    return out.select("event_id", "user_id", "ts", F.round("amt_sum_1h", 6).alias("amt_sum_1h"),
                      "amt_max_1d", "amt_min_3d", "signups_7d", "signups_30d")


@register("window_features_tiled", sql=ORACLE_WINDOW_FEATURES)
def window_features_tiled(spark, sf_dir):
    """The same features through minute, hour and day tiles: exact, linear in
    the rows of a user, for keys with many rows per window (H7, H10 at scale)."""
    ev = events(spark, sf_dir, "event_id", "user_id", "ts", "event_type", "value")
    aggs = [WindowAgg("amt_sum_1h", "sum", "value", H), WindowAgg("amt_max_1d", "max", "value", D),
            WindowAgg("amt_min_3d", "min", "value", 3 * D),
            WindowAgg("signups_7d", "count_if", F.col("event_type") == "signup", 7 * D),
            WindowAgg("signups_30d", "count_if", F.col("event_type") == "signup", 30 * D)]
    out = tiled_window_features(ev, "user_id", "ts", "event_id", aggs)
    return out.select("event_id", "user_id", "ts", F.round("amt_sum_1h", 6).alias("amt_sum_1h"),
                      "amt_max_1d", "amt_min_3d", "signups_7d", "signups_30d")


RANK_BOUND = 0.02  # of the sketches below; their error is under 1.33 % in 99 of 100 cases


@register("window_percentile", sql=f"""WITH e AS (SELECT event_id, user_id, ts, value, {E_US}(ts) AS t FROM events)
SELECT a.event_id, a.user_id, a.ts, quantile_disc(CASE WHEN b.t > a.t - {_us(H)} THEN b.value END, 0.5) AS p50_1h,
       count(b.value) AS n_1d, 1 AS rank_ok_1d
FROM e a JOIN e b ON a.user_id = b.user_id AND b.t <= a.t AND b.t > a.t - {_us(D)}
GROUP BY a.event_id, a.user_id, a.ts""")
def window_percentile(spark, sf_dir):
    """Median of the value over the past hour and day per user from KLL
    sketches kept as tile state (H8). p50_1h is exact for hours of up to 200
    values. The day's median is told by its rank: rank_ok_1d is 1 if the exact share of
    the window's values up to the median, and of those below it, leave one half
    within RANK_BOUND. The exact counterpart is ``window_median_exact``."""
    ev = events(spark, sf_dir, "event_id", "user_id", "ts", "value")
    out = tiled_window_features(ev, "user_id", "ts", "event_id", [
        WindowAgg("p50_1h", "quantile_sketch", "value", H, (0.5, 200)),
        WindowAgg("p50_1d", "quantile_sketch", "value", D, (0.5, 200)), WindowAgg("n_1d", "count", "value", D)])
    found = range_window_features(out, "user_id", "ts", [WindowAgg("seen", "values", "value", D)])
    below = F.size(F.filter("seen", lambda v: v < F.col("p50_1d"))) / F.col("n_1d")
    upto = F.size(F.filter("seen", lambda v: v <= F.col("p50_1d"))) / F.col("n_1d")
    ok = F.when(F.col("n_1d") == 0, F.col("p50_1d").isNull()).otherwise(
        (upto >= 0.5 - RANK_BOUND) & (below <= 0.5 + RANK_BOUND))
    return found.select("event_id", "user_id", "ts", "p50_1h", "n_1d", ok.cast("int").alias("rank_ok_1d"))


@register("window_median_exact", sql=f"""WITH e AS (SELECT event_id, user_id, ts, value, {E_US}(ts) AS t FROM events)
SELECT a.event_id, a.user_id, round(quantile_cont(b.value, 0.5), 6) AS median_1h
FROM e a JOIN e b ON a.user_id = b.user_id AND b.t <= a.t AND b.t > a.t - {_us(H)}
GROUP BY a.event_id, a.user_id""")
def window_median_exact(spark, sf_dir):
    """Exact median over the past hour per user, from the frame's values
    (collect_list over the range frame, then the interpolated middle)."""
    ev = events(spark, sf_dir, "event_id", "user_id", "ts", "value")
    out = range_window_features(ev, "user_id", "ts", [WindowAgg("median_1h", "median", "value", H)])
    return out.select("event_id", "user_id", F.round("median_1h", 6).alias("median_1h"))


@register("window_distinct", sql=f"""WITH e AS (SELECT event_id, user_id, {E_US}(ts) AS t,
                  CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT a.event_id, a.user_id, count(DISTINCT b.k) AS distinct_k_3d
FROM e a JOIN e b ON a.user_id = b.user_id AND b.t <= a.t AND b.t > a.t - {_us(3 * D)}
GROUP BY a.event_id, a.user_id""")
def window_distinct(spark, sf_dir):
    """Exact count of distinct ``props.k`` per user over 3 days (H9)."""
    ev = events(spark, sf_dir, "event_id", "user_id", "ts", "props") \
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    out = range_window_features(ev, "user_id", "ts", [WindowAgg("distinct_k_3d", "distinct", "k", 3 * D)])
    return out.select("event_id", "user_id", F.col("distinct_k_3d").cast("long").alias("distinct_k_3d"))


@register("window_distinct_approx", sql=f"""WITH e AS (SELECT event_id, user_id, {E_US}(ts) AS t,
                  CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT a.event_id, a.user_id, count(DISTINCT b.k) AS exact_k_3d, 1 AS within_5pct
FROM e a JOIN e b ON a.user_id = b.user_id AND b.t <= a.t AND b.t > a.t - {_us(3 * D)}
GROUP BY a.event_id, a.user_id""")
def window_distinct_approx(spark, sf_dir):
    """Distinct ``props.k`` per user over 3 days from HLL sketches kept as
    tile state, linear in the rows of a user (H9 sketch path), told by its
    error: within_5pct is 1 if it is within 5 % of the exact count."""
    ev = events(spark, sf_dir, "event_id", "user_id", "ts", "props") \
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    out = tiled_window_features(ev, "user_id", "ts", "event_id",
                                [WindowAgg("approx_k", "approx_distinct", "k", 3 * D)])
    out = range_window_features(out, "user_id", "ts", [WindowAgg("exact", "distinct", "k", 3 * D)])
    exact = F.col("exact").cast("long")
    return out.select("event_id", "user_id", exact.alias("exact_k_3d"),
                      (F.abs(F.col("approx_k") - exact) <= 0.05 * exact).cast("int").alias("within_5pct"))


@register("entity_rate", sql="""SELECT user_id, count(*) AS n_events,
       count(*) FILTER (WHERE event_type = 'error') AS n_errors,
       round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
       round(avg(value), 6) AS avg_value
FROM events GROUP BY user_id""")
def entity_rate(spark, sf_dir):
    """Error rate per user (H11); partial aggregation before the shuffle."""
    return _entity_rate(spark, sf_dir)


def _entity_rate(spark, sf_dir):
    ev = events(spark, sf_dir, "user_id", "event_type", "value")
    return ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"),
        F.round(F.avg("value"), 6).alias("avg_value"))


# The event types that become pivot columns.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("event_pivot", sql="SELECT user_id, " + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES) + ", count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN ("
          + ", ".join(f"'{t}'" for t in EVENT_TYPES) + ")) AS other FROM events GROUP BY user_id")
def event_pivot(spark, sf_dir):
    """Counts per event type per user, one column per type (H12), and one for
    all types not listed. The value list is given, so no extra job computes it."""
    ev = events(spark, sf_dir, "user_id", "event_type")
    kind = F.when(F.col("event_type").isin(EVENT_TYPES), F.col("event_type")).otherwise(F.lit("other"))
    columns = [*EVENT_TYPES, "other"]
    return (ev.select("user_id", kind.alias("event_type")).groupBy("user_id").pivot("event_type", columns).count()
            .fillna(0, subset=columns))


@register("sessions_30d", sql=f"""WITH e AS (SELECT user_id, {E_US}(ts) AS t FROM events),
g AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {_us(30 * 60)}
                              THEN 0 ELSE 1 END AS new_s FROM e),
s AS (SELECT user_id, t, sum(new_s) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g),
ss AS (SELECT user_id, sid, min(t) AS start_t FROM s GROUP BY user_id, sid),
edge AS (SELECT max({E_US}(ts)) AS et FROM events)
SELECT user_id, count(*) AS n_sessions,
       count(*) FILTER (WHERE start_t > (SELECT et FROM edge) - {_us(7 * D)}) AS n_sessions_7d,
       count(*) FILTER (WHERE start_t > (SELECT et FROM edge) - {_us(30 * D)}) AS n_sessions_30d
FROM ss GROUP BY user_id""")
def sessions_30d(spark, sf_dir):
    """Sessions (a gap of more than 30 minutes opens one) per user, in total
    and started within 7 and 30 days of the latest event time (H13, J3).
    Session starts come from a time-bucketed lag (skew-safe); streams use
    Spark's session_window (``sessionize``)."""
    ev = events(spark, sf_dir, "user_id", "ts")
    edge = ev.select(F.max(ts_micros("ts"))).scalar()
    s = session_starts(ev, "user_id", "ts", 30 * 60).filter("is_session_start") \
        .withColumn("st", ts_micros("ts"))
    return s.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.count_if(F.col("st") > edge - F.lit(7 * D * 1_000_000)).alias("n_sessions_7d"),
        F.count_if(F.col("st") > edge - F.lit(30 * D * 1_000_000)).alias("n_sessions_30d"))


SQL_FEATURE = """SELECT c.c_custkey, n.n_name, c.c_mktsegment,
       count(DISTINCT o.o_orderkey) AS n_orders,
       round(sum(l.l_extendedprice * (1 - l.l_discount)), 6) AS revenue,
       count(DISTINCT l.l_partkey) AS n_parts,
       round(avg(l.l_discount), 6) AS avg_discount
FROM {customer} c
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {orders} o ON o.o_custkey = c.c_custkey
JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
GROUP BY c.c_custkey, n.n_name, c.c_mktsegment"""

SQL_ROWS_PER_TASK = 500_000  # of orders and lineitem together


@register("sql_feature", sql=SQL_FEATURE.format(customer="customer", nation="nation", orders="orders",
                                                lineitem="lineitem"))
def sql_feature(spark, sf_dir):
    """A batch feature written in SQL: multi-table joins plus group by
    (E12, H14). Catalyst prunes columns into each scan; AQE picks the joins.
    The distinct counts keep a row's keys in a task's hash map, so shuffles
    have as many partitions as the rows ask for."""
    t = {n: read_table(spark, sf_dir, n) for n in ("customer", "nation", "orders", "lineitem")}
    rows = sum(read_table(spark, sf_dir, n, balance=False).count() for n in ("orders", "lineitem"))
    with shuffles_of(spark, rows, SQL_ROWS_PER_TASK):
        return materialize(spark.sql(SQL_FEATURE, **t), "sql-feature")


FEATURE_START = "2024-01-03 00:00:00"


@register("daily_tiles", sql=f"""SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS period, count(*) AS n,
       round(sum(value), 6) AS total, min(value) AS min_value, max(value) AS max_value
FROM events WHERE ts >= TIMESTAMP '{FEATURE_START}'
GROUP BY user_id, CAST(date_trunc('day', ts) AS DATE)""")
def daily_tiles(spark, sf_dir):
    """Daily per-user tiles of a scheduled batch view, rows before the
    feature start time ignored (H15, H16, B8); the filter reaches the scan."""
    ev = events(spark, sf_dir, "user_id", "ts", "value") \
        .filter(F.col("ts") >= F.lit(FEATURE_START).cast("timestamp_ntz"))
    t = time_tiles(ev, "user_id", "ts", "value", "day")
    return t.withColumn("total", F.round("total", 6))


TTL_DAYS = 2


@register("latest_values", sql=f"""WITH l AS (
  SELECT user_id, ts, event_id, value, event_type FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
edge AS (SELECT max({E_US}(ts)) AS et FROM events)
SELECT user_id, ts, event_id, value, event_type,
       {E_US}(ts) > (SELECT et FROM edge) - {_us(TTL_DAYS * D)} AS is_fresh
FROM l""")
def latest_values(spark, sf_dir):
    """Latest event per user (online value) and whether it is within the
    ttl of the latest event time (J2, H17)."""
    ev = events(spark, sf_dir, "user_id", "ts", "event_id", "value", "event_type")
    edge = ev.select(F.max(ts_micros("ts"))).scalar()
    lat = latest_per_key(ev, "user_id", "ts", "event_id", ["value", "event_type"])
    return lat.withColumn("is_fresh", ts_micros("ts") > edge - F.lit(TTL_DAYS * D * 1_000_000))


# FX11: the training spine; one row per order, a user and a request time.
def fx11_spine(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    ts = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST(o_orderkey % 30 AS INT), "
                "CAST(o_orderkey % 24 AS INT), 0, 0)")
    return o.select(F.col("o_orderkey").alias("spine_id"), F.col("o_custkey").alias("cust_key"),
                    (F.col("o_custkey") % 150).alias("user_id"), ts.alias("ts"),
                    F.col("o_totalprice").alias("amount"))


FX11_SQL = """spine AS (SELECT o_orderkey AS spine_id, o_custkey AS cust_key, o_custkey % 150 AS user_id,
       TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 30 AS INTEGER)) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS ts,
       o_totalprice AS amount FROM orders)"""
TRAIN_TTL_DAYS = 3


@register("training_set", sql=f"""WITH {FX11_SQL},
j AS (SELECT s.spine_id, s.user_id, s.ts, e.value, e.event_type, e.ts AS fts
      FROM spine s ASOF LEFT JOIN events e ON s.user_id = e.user_id AND s.ts >= e.ts)
SELECT spine_id, user_id, ts,
       CASE WHEN {E_US}(fts) > {E_US}(ts) - {_us(TRAIN_TTL_DAYS * D)} THEN value END AS value,
       CASE WHEN {E_US}(fts) > {E_US}(ts) - {_us(TRAIN_TTL_DAYS * D)} THEN event_type END AS event_type,
       CASE WHEN {E_US}(fts) > {E_US}(ts) - {_us(TRAIN_TTL_DAYS * D)} THEN fts END AS feature_ts
FROM j""")
def training_set(spark, sf_dir):
    """Point-in-time correct training rows: the latest event value known at
    each spine time, within a 3-day ttl (E11)."""
    sp = fx11_spine(spark, sf_dir).select("spine_id", "user_id", "ts")
    ev = events(spark, sf_dir, "user_id", "ts", "event_id", "value", "event_type")
    return asof_join(sp, ev, "user_id", "ts", ["value", "event_type"], TRAIN_TTL_DAYS * D, "event_id")


@register("service_vector", sql=f"""WITH {FX11_SQL},
l AS (SELECT user_id, value AS latest_value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
r AS (SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
             round(avg(value), 6) AS avg_value FROM events GROUP BY user_id),
c AS (SELECT o.o_custkey AS c_custkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 6) AS revenue
      FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey)
SELECT s.spine_id, s.user_id, l.latest_value AS user_latest__value, r.error_rate AS user_rate__error_rate,
       c.revenue AS customer__revenue, s.amount / 1000.0 > r.avg_value AS amount_is_higher_than_average
FROM spine s LEFT JOIN l USING (user_id) LEFT JOIN r USING (user_id)
LEFT JOIN c ON c.c_custkey = s.cust_key""")
def service_vector(spark, sf_dir):
    """A feature service: three views looked up by key side by side, one
    with a join-key override (cust_key -> c_custkey), plus a request-time
    comparison (E10, E13, C23, K5). The views are per-key aggregates; AQE
    broadcasts them only when their runtime size is under the threshold."""
    sp = fx11_spine(spark, sf_dir)
    ev = events(spark, sf_dir, "user_id", "ts", "event_id", "value", "event_type")
    latest = latest_per_key(ev, "user_id", "ts", "event_id", ["value"]) \
        .select("user_id", F.col("value").alias("user_latest__value"))
    rate = _entity_rate(spark, sf_dir).select("user_id", F.col("error_rate").alias("user_rate__error_rate"),
                                              "avg_value")
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    cust = (o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 6).alias("customer__revenue")))
    out = (sp.join(latest, "user_id", "left").join(rate, "user_id", "left")
           .join(cust, sp["cust_key"] == cust["c_custkey"], "left"))
    return out.select("spine_id", "user_id", "user_latest__value", "user_rate__error_rate", "customer__revenue",
                      ((F.col("amount") / 1000.0) > F.col("avg_value")).alias("amount_is_higher_than_average"))


@register("request_cosine", sql="""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT q.vec_id AS request_id, u.vec_id AS user_vec_id,
       round(list_dot_product(q.e, u.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(u.e, u.e))), 6) + 0.0
         AS cosine_similarity
FROM v q JOIN v u ON u.vec_id = q.vec_id + 1""")
def request_cosine(spark, sf_dir):
    """Request-time cosine between a request vector and a stored vector
    (each vector against the next one by id) (C21, K5)."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    q = emb.select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("qe"))
    u = emb.select((F.col("vec_id") - 1).alias("request_id"), F.col("vec_id").alias("user_vec_id"),
                   F.col("embedding").alias("ue"))
    return q.join(u, "request_id").select("request_id", "user_vec_id",
                                          F.round(cosine("qe", "ue"), 6).alias("cosine_similarity"))


# FX12: event and home coordinates derived from ids.
@register("request_distance", sql="""WITH c AS (
  SELECT event_id, user_id,
         ((user_id * 37) % 180) - 90 + (event_id % 100) / 100.0 AS lat,
         ((event_id * 53) % 360) - 180 AS lon,
         ((user_id * 17) % 180) - 90 AS home_lat,
         ((user_id * 29) % 360) - 180 AS home_lon FROM events)
SELECT event_id, user_id,
       round(2 * 6371.0 * asin(sqrt(least(1.0,
         pow(sin(radians(home_lat - lat) / 2), 2) +
         cos(radians(lat)) * cos(radians(home_lat)) * pow(sin(radians(home_lon - lon) / 2), 2)))), 6) AS distance_km
FROM c""")
def request_distance(spark, sf_dir):
    """Distance in km between an event and the user's home."""
    ev = events(spark, sf_dir, "event_id", "user_id")
    u, e = F.col("user_id"), F.col("event_id")
    c = ev.select("event_id", "user_id",
                  (((u * 37) % 180) - 90 + (e % 100) / 100.0).alias("lat"),
                  (((e * 53) % 360) - 180).cast("double").alias("lon"),
                  (((u * 17) % 180) - 90).cast("double").alias("home_lat"),
                  (((u * 29) % 360) - 180).cast("double").alias("home_lon"))
    return c.select("event_id", "user_id",
                    F.round(haversine_km("lat", "lon", "home_lat", "home_lon"), 6).alias("distance_km"))
