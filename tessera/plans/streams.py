"""Structured Streaming queries: each lands its input in event-time order,
runs incremental ``availableNow`` passes, and returns the sink as a batch
DataFrame (checked against the batch SQL of the same definition)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.embed import HashingEmbedder
from tessera.operators.features import WindowAgg, latest_per_key
from tessera.operators.views import FeatureView
from tessera.plans.corpus import CHUNKS_SQL, fx1_markdown
from tessera.plans.registry import register
from tessera.plans.search import embed_sql
from tessera.sources.tables import read_table
from tessera.streaming.features import dedup_events, sliding_aggregates, with_event_time
from tessera.streaming.ingest import ChunkIndex
from tessera.streaming.late import LateRows
from tessera.streaming.runner import ChangeLog, FileStream, bounded_slices, time_slices

N_SLICES = 4
MIN_US = 60 * 1_000_000


def _event_stream(spark, sf_dir, name, *cols):
    ev = with_event_time(read_table(spark, sf_dir, "events", *cols))
    return ev, FileStream(spark, name, ev.schema)


@register("stream_sliding", sql=f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events),
mx AS (SELECT max(t) AS m FROM e),
w AS (SELECT user_id, value, (t // {10 * MIN_US}) * {10 * MIN_US} - k * {10 * MIN_US} AS ws
      FROM e CROSS JOIN range(0, 6) r(k))
SELECT user_id, make_timestamp(ws) AS window_start, make_timestamp(ws + {60 * MIN_US}) AS window_end,
       count(*) AS n, round(sum(value), 6) AS total
FROM w GROUP BY user_id, ws
HAVING ws + {60 * MIN_US} <= (SELECT m FROM mx) - {10 * MIN_US}""")
def stream_sliding(spark, sf_dir):
    """1-hour windows sliding every 10 minutes per user, watermark 10
    minutes, append mode: each window is emitted once, when closed (J1, J3).
    Equals the batch result cut at the final watermark."""
    ev, fs = _event_stream(spark, sf_dir, "stream-sliding", "user_id", "ts", "value")
    for sl in bounded_slices(ev, "ts", N_SLICES, f"{fs.base}/slices"):
        fs.land(sl)
        fs.run_append(lambda s: sliding_aggregates(s, "user_id", "ts", "value"))
    out = fs.read_sink()
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n",
                      F.round("total", 6).alias("total"))


def user_type_view():
    """Activity of a user by event type over a day."""
    return FeatureView(
        "user_type_activity", ["user_id", "event_type"], "ts",
        transform=lambda df: df.withColumn("hour", F.hour("ts")),
        aggregations=[WindowAgg("n", "count", None, 86400), WindowAgg("total", "sum", "value", 86400),
                      WindowAgg("least", "min", "value", 86400), WindowAgg("most", "max", "value", 86400),
                      WindowAgg("n_large", "count_if", F.col("value") > 50, 86400),
                      WindowAgg("n_hours", "approx_distinct", "hour", 86400),
                      WindowAgg("q90", "quantile_sketch", "value", 86400, (0.9,))])


@register("stream_view", sql=f"""WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t, value FROM events),
w AS (SELECT e.*, (t // {360 * MIN_US}) * {360 * MIN_US} - k * {360 * MIN_US} AS ws FROM e CROSS JOIN range(0, 4) r(k))
SELECT user_id, event_type, make_timestamp(ws) AS window_start, make_timestamp(ws + {1440 * MIN_US}) AS window_end,
       count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most,
       count(*) FILTER (WHERE value > 50) AS n_large, count(DISTINCT t // {60 * MIN_US} % 24) AS n_hours,
       quantile_disc(value, 0.9) AS q90
FROM w GROUP BY user_id, event_type, ws
HAVING ws + {1440 * MIN_US} <= (SELECT max(t) FROM e) - {10 * MIN_US}""")
def stream_view(spark, sf_dir):
    """A feature view's own aggregations, of six kinds over two keys, in
    windows of a day that slide by six hours; the stream gives the batch
    result cut at the final watermark (J1, J4)."""
    ev, fs = _event_stream(spark, sf_dir, "stream-view", "user_id", "event_type", "ts", "value")
    view = user_type_view()
    for sl in bounded_slices(ev, "ts", N_SLICES, f"{fs.base}/slices"):
        fs.land(sl)
        fs.run_append(lambda s: view.window_aggregates(s, 86400, "6 hours"))
    out = fs.read_sink()
    return out.select("user_id", "event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n", F.round("total", 6).alias("total"),
                      "least", "most", "n_large", "n_hours", "q90")


@register("stream_dedup", sql="SELECT event_id, user_id, ts, event_type, value FROM events")
def stream_dedup(spark, sf_dir):
    """Every slice lands twice and the last hour of the previous slice lands
    again with the next one; dropDuplicatesWithinWatermark keeps one copy
    of each event (J6)."""
    ev, fs = _event_stream(spark, sf_dir, "stream-dedup", "event_id", "user_id", "ts", "event_type", "value")
    prev_tail = None
    for sl in time_slices(ev, "ts", N_SLICES):
        fs.land(sl)
        fs.land(sl)
        if prev_tail is not None:
            fs.land(prev_tail)
        fs.run_append(lambda s: dedup_events(s, "event_id", "ts", "1 hour"))
        mx = sl.select(F.max("ts")).scalar()
        prev_tail = sl.filter(F.col("ts") > mx - F.expr("INTERVAL 1 HOUR") + F.expr("INTERVAL 1 MINUTE"))
    out = fs.read_sink()
    return out.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")


@register("stream_latest", sql="""SELECT user_id, ts, event_id, value, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest(spark, sf_dir):
    """Latest value per user: a running max_by in update mode, so each
    micro-batch hands on the users it changed to the change log, whose latest
    rows equal the batch latest values (J2, J4)."""
    ev, fs = _event_stream(spark, sf_dir, "stream-latest", "user_id", "ts", "event_id", "value", "event_type")
    log = ChangeLog(spark, f"{fs.base}/log")
    for sl in time_slices(ev, "ts", N_SLICES):
        fs.land(sl)
        fs.run_foreach_batch(lambda s: latest_per_key(s, "user_id", "ts", "event_id", ["value", "event_type"]),
                             log.write, mode="update")
    lat = latest_per_key(log.read(), "user_id", "ts", "event_id", ["value", "event_type"])
    return lat.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "value", "event_type")


# Every seventh event arrives one slice after its own.
_LATE_SQL = f"""e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS t FROM events),
mm AS (SELECT min(t) AS lo, (max(t) - min(t)) // {N_SLICES} + 1 AS step FROM e),
s AS (SELECT event_id, user_id, ts, t, (t - lo) // step + CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END AS batch
      FROM e CROSS JOIN mm),
bm AS (SELECT batch, max(max(t)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
       FROM s GROUP BY batch),
marked AS (SELECT s.*, coalesce(t < seen - {60 * MIN_US}, false) AS late FROM s JOIN bm USING (batch))"""


def _late_stream(spark, sf_dir):
    ev, fs = _event_stream(spark, sf_dir, "stream-late", "event_id", "user_id", "ts")
    split = LateRows(spark, f"{fs.base}/split", "event_id long, user_id long, ts timestamp", "ts", 3600)
    held = F.col("event_id") % 7 == 3
    slices = time_slices(ev, "ts", N_SLICES)
    for i in range(N_SLICES + 1):
        own = slices[i].where(~held) if i < len(slices) else None
        rest = slices[i - 1].where(held) if 0 < i <= len(slices) else None
        arriving = [d for d in (own, rest) if d is not None]
        for d in arriving:
            fs.land(d)
        if arriving:
            fs.run_foreach_batch(lambda s: s, split.write)
    return split


@register("stream_late_counts", sql=f"""WITH {_LATE_SQL}
SELECT count(*) FILTER (WHERE NOT late) AS n_on_time, count(*) FILTER (WHERE late) AS n_late, batch FROM marked
GROUP BY batch""")
def stream_late_counts(spark, sf_dir):
    """On-time and late rows of every micro-batch, watermark one hour behind
    the largest event time of the batches before (J6)."""
    return _late_stream(spark, sf_dir).counts()


@register("stream_late_rows", sql=f"WITH {_LATE_SQL} SELECT event_id, user_id, ts FROM marked WHERE late")
def stream_late_rows(spark, sf_dir):
    """The rows that came too late, from the side table."""
    late = _late_stream(spark, sf_dir).late.read()
    return late.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


_INGEST_EMBED = embed_sql("u", "u", "id", "text_chunk", 64, [("uv", "u", "id", "text_chunk")])


@register("stream_ingest", sql=f"""WITH {CHUNKS_SQL},
u AS (SELECT md5(text_chunk) AS id, conv_id, section_no, header, text_chunk FROM chunks
      QUALIFY row_number() OVER (PARTITION BY md5(text_chunk) ORDER BY conv_id DESC, section_no DESC) = 1),
{_INGEST_EMBED}
SELECT u.id, conv_id AS doc_id, section_no, header, bucket, round(value, 6) + 0.0 AS value
FROM u JOIN uv_vec USING (id)""")
def stream_ingest(spark, sf_dir):
    """New Markdown documents arrive as files; every micro-batch is cut into
    chunks and terms and appended to the index with the change it makes to the
    document frequencies. The newest copy of a chunk wins on read, and vectors
    are weighed from the merged frequencies (J5, A8): the same rows as a build
    over all documents at once."""
    docs = fx1_markdown(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("content").alias("text"))
    fs = FileStream(spark, "stream-ingest", docs.schema)
    index = ChunkIndex(spark, f"{fs.base}/index")
    for i in range(N_SLICES):
        fs.land(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(N_SLICES)) == i))
        fs.run_foreach_batch(lambda s: s, index.write)
    found = index.chunks().join(index.vectors(HashingEmbedder(64)), "id")
    return found.select("id", "doc_id", "section_no", "header", "bucket",
                        (F.round("value", 6) + F.lit(0.0)).alias("value"))
