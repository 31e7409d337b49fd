"""Late rows of a stream against the definition, restarts and odd rows included."""
import datetime as dt

from tessera.session import scratch_path
from tessera.streaming.late import LateRows


def batch(spark, rows):
    return spark.createDataFrame([(i, None if m is None else dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m))
                                  for i, m in rows], "id long, ts timestamp")


def test_late_rows(spark):
    split = LateRows(spark, scratch_path(spark, "late"), "id long, ts timestamp", "ts", 600)
    lots = [[(1, 0), (2, 30), (3, None)], [(4, 19), (5, 20), (6, 5), (7, None)], [], [(8, 60), (9, 19)], [(10, 49), (11, 50)]]
    for n, rows in enumerate(lots):
        split.write(batch(spark, rows), n)
    want = [(0, 3, 0), (1, 2 + 0, 2), (2, 0, 0), (3, 1, 1), (4, 1, 1)]
    assert sorted(tuple(r) for r in split.counts().collect()) == want
    assert sorted(r["id"] for r in split.late.read().collect()) == [4, 6, 9, 10]
    assert sorted(r["id"] for r in split.on_time.read().collect()) == [1, 2, 3, 5, 7, 8, 11]
    split.write(batch(spark, lots[4]), 4)  # a batch that is run again
    split.write(batch(spark, lots[1]), 1)
    assert sorted(tuple(r) for r in split.counts().collect()) == want
    assert split.late.read().count() == 4


def test_no_batches(spark):
    split = LateRows(spark, scratch_path(spark, "late"), "id long, ts timestamp", "ts", 600)
    assert split.counts().count() == 0 and split.late.read().count() == 0
