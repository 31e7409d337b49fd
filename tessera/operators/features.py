"""Time-window features, as-of joins, latest values and tiles.

Skew: the natural plan for per-key range windows and as-of lookups is one
window partition per key, so a key holding a third of all rows would be a
third of the job in one task. Here every key is cut into time buckets and
the window is partitioned by (key, bucket). A row is copied into the next
bucket only when it can still fall inside a frame there (it is less than
the largest window, or the ttl, older than the bucket start), so the extra
rows are bounded by ``window / bucket`` and results stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def ts_micros(ts) -> Column:
    """Microseconds since the epoch (TIMESTAMP_NTZ read as UTC wall time)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


@dataclass(frozen=True)
class WindowAgg:
    """One feature: ``fn`` over ``col`` for rows in ``(t - seconds, t]``.

    fn: sum, max, min, avg, count, count_if (col is a boolean), distinct
    (exact count of distinct values), approx_distinct, percentile (approx;
    params = (percentage, accuracy)), median (exact, interpolated) and values
    (the frame's values themselves; both for frames of bounded size).
    quantile_sketch is for tiles only.
    """
    name: str
    fn: str
    col: object
    seconds: int
    params: tuple = field(default=())

    def expr(self) -> Column:
        c = F.col(self.col) if isinstance(self.col, str) else self.col
        if self.fn == "sum":
            return F.sum(c)
        if self.fn == "max":
            return F.max(c)
        if self.fn == "min":
            return F.min(c)
        if self.fn == "avg":
            return F.avg(c)
        if self.fn == "count":
            return F.count(c if c is not None else F.lit(1))
        if self.fn == "count_if":
            return F.count_if(c)
        if self.fn == "distinct":
            return F.collect_set(c)
        if self.fn == "approx_distinct":
            return F.approx_count_distinct(c)
        if self.fn == "percentile":
            pct, acc = self.params or (0.5, 10000)
            return F.percentile_approx(c, pct, acc)
        if self.fn in ("median", "values"):
            return F.collect_list(c)
        raise ValueError(f"unknown window aggregate {self.fn}")

    def finish(self, framed: Column) -> Column:
        """Turn the windowed aggregate into the feature value."""
        if self.fn == "distinct":
            return F.size(framed)
        if self.fn != "median":
            return framed
        framed = F.array_sort(framed)
        n = F.size(framed)
        half = (n / 2).cast("int")
        odd = F.element_at(framed, ((n + 1) / 2).cast("int"))
        even = (F.element_at(framed, half) + F.element_at(framed, half + 1)) / 2
        return F.when(n == 0, F.lit(None)).when(n % 2 == 1, odd).otherwise(even)


def _bucketed(df: DataFrame, ts: str, reach_us: int, bucket_us: int, is_context_source=None):
    """Own rows plus next-bucket copies of rows within ``reach_us`` of the
    next bucket start. ``is_context_source`` limits which rows are copied."""
    base = df.withColumn("_tsu", ts_micros(ts)).withColumn("_b", F.floor(F.col("_tsu") / F.lit(bucket_us)))
    own = base.withColumn("_own", F.lit(True))
    near_end = F.col("_tsu") > (F.col("_b") + 1) * F.lit(bucket_us) - F.lit(reach_us)
    if is_context_source is not None:
        near_end = near_end & is_context_source
    ctx = base.filter(near_end).withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    return own.unionByName(ctx)


def range_window_features(df: DataFrame, key: str, ts: str, aggs: list[WindowAgg],
                          bucket_seconds: int | None = None) -> DataFrame:
    """Add one column per ``WindowAgg``: the aggregate over the same key's
    rows with time in ``(t - w, t]`` (rows at the same instant included)."""
    reach = max(a.seconds for a in aggs) * US
    bucket = (bucket_seconds * US) if bucket_seconds else 4 * reach
    if bucket < reach:
        raise ValueError("bucket must be at least the largest window")
    u = _bucketed(df, ts, reach, bucket)
    w = Window.partitionBy(key, "_b").orderBy("_tsu")
    cols = [a.finish(a.expr().over(w.rangeBetween(-a.seconds * US + 1, 0))).alias(a.name) for a in aggs]
    out = u.select(*df.columns, "_own", *cols)
    return out.filter("_own").drop("_own")


def asof_join(spine: DataFrame, features: DataFrame, key: str, ts: str, value_cols: list[str],
              ttl_seconds: int, tie_col: str, bucket_seconds: int | None = None,
              feature_ts_name: str = "feature_ts") -> DataFrame:
    """Point-in-time lookup: for each spine row, the feature row of the same
    key with the latest time <= the spine time (equal times count as known;
    among equal feature times the largest ``tie_col`` wins), kept only while
    ``feature_ts > spine_ts - ttl``. Spine rows keep all their columns; the
    feature columns are null when nothing qualifies.

    One shuffle by (key, time bucket); feature rows are copied into the next
    bucket only within the ttl of its start, so a hot key is split and no
    pair of rows is ever formed.
    """
    reach = ttl_seconds * US
    bucket = (bucket_seconds * US) if bucket_seconds else 4 * reach
    if bucket < reach:
        raise ValueError("bucket must be at least the ttl")
    payload = F.struct(F.col(ts).alias("fts"), F.col(tie_col).alias("tie"), *[F.col(c) for c in value_cols])
    fe = features.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), payload.alias("_p"),
                         F.lit(0).alias("_side"), F.col(tie_col).alias("_tie"))
    sp_cols = spine.columns
    sp = spine.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.lit(None).cast(fe.schema["_p"].dataType)
                      .alias("_p"), F.lit(1).alias("_side"), F.lit(None).cast(fe.schema["_tie"].dataType)
                      .alias("_tie"), F.struct(*[F.col(c) for c in sp_cols]).alias("_row"))
    fe = fe.withColumn("_row", F.lit(None).cast(sp.schema["_row"].dataType))
    u = _bucketed(fe.unionByName(sp), "_ts", reach, bucket, is_context_source=F.col("_side") == 0)
    w = (Window.partitionBy("_k", "_b").orderBy("_tsu", "_side", "_tie")
         .rowsBetween(Window.unboundedPreceding, 0))
    found = F.last("_p", ignorenulls=True).over(w)
    res = u.select("_own", "_side", "_tsu", "_row", found.alias("_f")).filter(F.col("_own") & (F.col("_side") == 1))
    fresh = ts_micros(F.col("_f.fts")) > F.col("_tsu") - F.lit(reach)
    keep = F.when(fresh, F.col("_f"))
    return res.select("_row.*", *[keep[c].alias(c) for c in value_cols],
                      keep["fts"].alias(feature_ts_name))


def latest_per_key(df: DataFrame, key: str, ts: str, tie_col: str, cols: list[str]) -> DataFrame:
    """Latest row per key (largest time, then largest ``tie_col``). A hash
    aggregate with map-side partial max_by: hot keys reduce before the shuffle."""
    order = F.struct(F.col(ts), F.col(tie_col))
    keep = list(dict.fromkeys([ts, tie_col, *cols]))
    best = F.max_by(F.struct(*[F.col(c) for c in keep]), order).alias("_b")
    return df.groupBy(key).agg(best).select(key, "_b.*")


def sessionize(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions per key: events closer than ``gap`` belong to one session.
    Returns ``(key, session_start, session_end, n_events)`` where end is the
    last event plus the gap (Spark's session_window)."""
    sw = F.session_window(F.col(ts).cast("timestamp"), gap)
    return (df.groupBy(key, sw.alias("s"))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n_events"))


def time_tiles(df: DataFrame, key: str, ts: str, value: str, unit: str = "day") -> DataFrame:
    """Per key and period: count, sum, min, max (the partial aggregates a
    scheduled batch view writes once per period)."""
    period = F.date_trunc(unit, F.col(ts)).cast("date") if unit == "day" else F.date_trunc(unit, F.col(ts))
    return df.groupBy(key, period.alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def materialize(df: DataFrame, path: str, partition_col: str = "period") -> None:
    """Write a batch view offline, one folder per period. Dynamic partition
    overwrite: a run that recomputes some periods replaces only those."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


def session_starts(df: DataFrame, key: str, ts: str, gap_seconds: int, bucket_seconds: int = 7 * 86400,
                   tie_col: str | None = None) -> DataFrame:
    """Flag the events that open a session: the first event of a key, or one
    more than ``gap`` after the key's previous event (gaps-and-islands).

    Skew-safe: the previous event is found within (key, time bucket) by a
    lag; for a bucket's first event it is the last event of the key's
    previous non-empty bucket, taken from one row per (key, bucket). A key
    holding a third of all rows is spread over its buckets. Counting flags
    counts sessions; a session's start time is its flagged event's time.
    Among events at the same instant, ``tie_col`` decides which one opens.
    """
    base = df.withColumn("_tsu", ts_micros(ts)).withColumn(
        "_b", F.floor(F.col("_tsu") / F.lit(bucket_seconds * US)))
    w = Window.partitionBy(key, "_b").orderBy("_tsu", *([tie_col] if tie_col else []))
    with_prev = base.withColumn("_prev", F.lag("_tsu").over(w))
    last_per_bucket = base.groupBy(key, "_b").agg(F.max("_tsu").alias("_last"))
    wb = Window.partitionBy(key).orderBy("_b")
    carry = last_per_bucket.select(key, "_b", F.lag("_last").over(wb).alias("_carry"))
    out = with_prev.join(carry, [key, "_b"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    return (out.withColumn("is_session_start", prev.isNull() | (F.col("_tsu") - prev > F.lit(gap_seconds * US)))
            .drop("_tsu", "_b", "_prev", "_carry"))


TILE_FNS = ("sum", "count", "count_if", "min", "max", "approx_distinct", "quantile_sketch")
PYRAMID = (60, 3600, 86400)  # tile sizes in seconds, each dividing the next
QUANTILE_K = 200             # of the KLL sketches: rank error about 1.33 % (99 % of the time); exact up to k values


def _tile_input(a: WindowAgg) -> Column:
    c = F.col(a.col) if isinstance(a.col, str) else a.col
    if a.fn == "count":
        return F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long") if c is not None else F.lit(1).cast("long")
    if a.fn == "count_if":
        return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return c.cast("double") if a.fn == "quantile_sketch" else c


def _tile_agg(a: WindowAgg, c: Column) -> Column:
    """Aggregate raw tile inputs (values; a sketch for the approximate ones)."""
    if a.fn == "approx_distinct":
        return F.hll_sketch_agg(c)
    if a.fn == "quantile_sketch":
        return F.kll_sketch_agg_double(c, F.lit(a.params[1] if len(a.params) > 1 else QUANTILE_K))
    return {"sum": F.sum, "count": F.sum, "count_if": F.sum, "min": F.min, "max": F.max}[a.fn](c)


def sketch_state(a: WindowAgg) -> Column:
    """State of fixed size of an aggregate over a group of raw rows."""
    if a.fn not in TILE_FNS:
        raise ValueError(f"aggregate {a.fn} has no state of fixed size; use one of {', '.join(TILE_FNS)}")
    return _tile_agg(a, _tile_input(a))


def sketch_value(a: WindowAgg, state: Column) -> Column:
    """The feature value of a ``sketch_state``."""
    return _tile_finish(a, state)


def _tile_merge(a: WindowAgg, c: Column) -> Column:
    """Aggregate partial results (tile aggregates / sketches)."""
    if a.fn == "approx_distinct":
        return F.hll_union_agg(c)
    if a.fn == "quantile_sketch":
        return F.kll_merge_agg_double(c)
    return _tile_agg(a, c)


def _tile_add(a: WindowAgg, parts: list[Column]) -> Column:
    """One partial result of several; null parts are empty."""
    if a.fn in ("min", "max") and len(parts) > 1:
        return (F.least if a.fn == "min" else F.greatest)(*parts)   # both skip nulls
    add = {"approx_distinct": F.hll_union, "quantile_sketch": F.kll_sketch_merge_double}.get(
        a.fn, lambda x, y: x + y)
    out = parts[0]
    for p in parts[1:]:
        out = F.when(out.isNull(), p).when(p.isNull(), out).otherwise(add(out, p))
    return out


def _tile_finish(a: WindowAgg, c: Column) -> Column:
    if a.fn == "approx_distinct":
        return F.coalesce(F.hll_sketch_estimate(c), F.lit(0).cast("long"))
    if a.fn == "quantile_sketch":
        pct = a.params[0] if a.params else 0.5
        return F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(pct)))
    return F.coalesce(c, F.lit(0).cast("long")) if a.fn in ("count", "count_if") else c


def _whole_tiles(tiles: DataFrame, key: str, aggs: list[WindowAgg], size: int) -> DataFrame:
    """(key, _t, _m_name): aggregate of the whole tiles between a window's
    first and last one. Tiles are windowed in buckets, with copies of those
    that the next bucket's frames reach."""
    counts = {a.name: a.seconds // size for a in aggs}
    reach = max(counts.values())
    bucket = max(4 * reach, 1024)
    own = tiles.withColumn("_bk", F.floor(F.col("_t") / bucket)).withColumn("_own", F.lit(True))
    near = own.where(F.pmod("_t", F.lit(bucket)) >= bucket - reach)
    both = own.unionByName(near.withColumn("_bk", F.col("_bk") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_bk").orderBy("_t")
    framed = [_tile_merge(a, F.col(f"_v_{a.name}")).over(w.rangeBetween(-(counts[a.name] - 1), -1))
              .alias(f"_m_{a.name}") for a in aggs]
    return both.select(key, "_t", "_own", *framed).where("_own").drop("_own")


def _after(values: DataFrame, asked: DataFrame, part: list[str], at: str, aggs: list[WindowAgg], agg) -> DataFrame:
    """For each row of ``asked`` (part, at, and columns of its own): the
    aggregate of the rows of ``values`` in its part that lie after ``at``. One
    running aggregate from the end backwards."""
    names = [f"_v_{a.name}" for a in aggs]
    mine = [c for c in asked.columns if c not in (*part, at)]
    rows = values.select(*part, at, F.lit(1).alias("_side"), *names,
                         *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in mine])
    questions = asked.select(*part, at, F.lit(0).alias("_side"),
                             *[F.lit(None).cast(values.schema[n].dataType).alias(n) for n in names], *mine)
    w = Window.partitionBy(*part).orderBy(F.col(at).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.unionByName(questions).select("_side", *part, *mine, *[
        agg(a, F.col(f"_v_{a.name}")).over(w).alias(f"_s_{a.name}") for a in aggs]).where("_side = 0").drop("_side"))


def _starts(found: DataFrame, by: list[str], aggs: list[WindowAgg], steps: dict[str, int]) -> DataFrame:
    """One row for each key of ``by``: each aggregate at its own step back."""
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_back") == steps[a.name], F.col(f"_s_{a.name}")))
                                    .alias(f"_s_{a.name}") for a in aggs])


def _backs(steps: dict[str, int]) -> Column:
    return F.explode(F.array(*[F.lit(m).cast("long") for m in sorted(set(steps.values()))])).alias("_back")


def tiled_window_features(df: DataFrame, key: str, ts: str, id_col: str, aggs: list[WindowAgg],
                          tiles: tuple[int, ...] = PYRAMID) -> DataFrame:
    """(t - w, t] aggregates for sum / count / count_if / min / max (exact),
    approx_distinct (HLL sketches) and quantile_sketch (KLL sketches; params =
    (fraction, k)), for windows that are whole multiples of the smallest tile.

    A sliding range frame re-aggregates the whole frame for each row, which is
    quadratic for a key with many rows per window. Here rows are aggregated
    into tiles, and those into the next larger ones, up to the largest tile
    that divides a window. A window is put together from, at its top size, the
    whole tiles inside it (a short frame); at each smaller size, the tiles
    before its end within the end's larger tile and those after its start
    within the start's larger tile; and rows in the two smallest tiles at its
    ends. The before and after parts are running aggregates, forwards and
    backwards, so every step is linear in the rows and tiles it reads, and is
    dealt by (key, tile): a hot key is spread over its tiles. ``id_col`` must
    identify a row within its key.
    """
    for a in aggs:
        if a.fn not in TILE_FNS or a.seconds % tiles[0]:
            raise ValueError(f"{a.name}: tiles need {TILE_FNS} and a window that is a multiple of the tile")
    top = {a.name: max(i for i, size in enumerate(tiles) if a.seconds % size == 0) for a in aggs}
    tau = tiles[0] * US
    base = (df.withColumn("_tsu", ts_micros(ts)).withColumn("_t", F.floor(F.col("_tsu") / F.lit(tau)))
            .withColumn("_off", F.col("_tsu") - F.col("_t") * F.lit(tau)))
    base = base.select("*", *[_tile_input(a).alias(f"_v_{a.name}") for a in aggs])
    level = [base.groupBy(key, "_t").agg(*[_tile_agg(a, F.col(f"_v_{a.name}")).alias(f"_v_{a.name}") for a in aggs])]
    for small, large in zip(tiles, tiles[1:max(top.values()) + 1], strict=False):
        level.append(level[-1].groupBy(key, F.floor(F.col("_t") / (large // small)).alias("_t")).agg(
            *[_tile_merge(a, F.col(f"_v_{a.name}")).alias(f"_v_{a.name}") for a in aggs]))

    found = None  # (key, _t, _c_name): what lies outside the ends' tiles of a size
    for i in range(len(level) - 1, -1, -1):
        parts = {a.name: [] for a in aggs}
        higher = [a for a in aggs if top[a.name] > i]
        here = level[i]
        if higher:
            ratio = tiles[i + 1] // tiles[i]
            here = here.withColumn("_up", F.floor(F.col("_t") / ratio))
            w = Window.partitionBy(key, "_up").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
            steps = {a.name: a.seconds // tiles[i] for a in higher}
            asked = here.select(key, F.col("_t").alias("_at"), _backs(steps)).select(
                key, F.floor((F.col("_at") - F.col("_back")) / ratio).alias("_up"),
                (F.col("_at") - F.col("_back")).alias("_t"), "_at", "_back")
            after = _starts(_after(here, asked, [key, "_up"], "_t", higher, _tile_merge), [key, "_at"], higher, steps)
            here = here.select("*", *[_tile_merge(a, F.col(f"_v_{a.name}")).over(w).alias(f"_p_{a.name}")
                                      for a in higher])
            here = (here.join(found.withColumnRenamed("_t", "_up"), [key, "_up"])
                    .join(after.withColumnRenamed("_at", "_t"), [key, "_t"], "left"))
            for a in higher:
                parts[a.name] += [F.col(f"_{x}_{a.name}") for x in "cps"]
        whole = [a for a in aggs if top[a.name] == i and a.seconds > tiles[i]]
        if whole:
            here = here.join(_whole_tiles(level[i], key, whole, tiles[i]), [key, "_t"], "left")
            for a in whole:
                parts[a.name].append(F.col(f"_m_{a.name}"))
        found = here.select(key, "_t", *[
            (_tile_add(a, parts[a.name]) if parts[a.name] else F.lit(None).cast(
                level[i].schema[f"_v_{a.name}"].dataType)).alias(f"_c_{a.name}") for a in aggs])

    w = Window.partitionBy(key, "_t").orderBy("_off").rangeBetween(Window.unboundedPreceding, 0)
    rows = base.select(*df.columns, "_t", *[_tile_agg(a, F.col(f"_v_{a.name}")).over(w).alias(f"_a_{a.name}")
                                            for a in aggs])
    steps = {a.name: a.seconds // tiles[0] for a in aggs}
    asked = base.select(key, "_t", "_off", F.col(id_col).alias("_id"), _backs(steps)).select(
        key, (F.col("_t") - F.col("_back")).alias("_t"), "_off", "_id", "_back")
    first = _starts(_after(base, asked, [key, "_t"], "_off", aggs, _tile_agg), [key, "_id"], aggs, steps)
    out = (rows.join(found, [key, "_t"], "left")
           .join(first.withColumnRenamed("_id", id_col), [key, id_col], "left"))
    return out.select(*df.columns, *[
        _tile_finish(a, _tile_add(a, [F.col(f"_{x}_{a.name}") for x in "acs"])).alias(a.name) for a in aggs])
