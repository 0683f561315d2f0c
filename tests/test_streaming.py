"""The streamed rollup equals the batch rollup over the same events."""

import tempfile
import time

from pyspark.sql import functions as F

from vigil.sources.activity import read_table, user_day_from_events
from vigil.streaming.rollup import start_partial_stream, user_day_from_partials

SF = "/root/testdata/sf0.001"


def test_stream_rollup_matches_batch(spark):
    work = tempfile.mkdtemp(prefix="vigil-stream-")
    src = f"{work}/events"
    events = read_table(spark, SF, "events")
    # the event log arrives in time order, in three files written one after
    # the other (the file source reads oldest first; events older than the
    # watermark would be dropped as late, which is the streaming contract)
    for lo, hi in ((0, 10), (10, 20), (20, 31)):
        part = events.where(F.dayofmonth("ts").between(lo + 1, hi))
        part.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.2)
    q = start_partial_stream(spark, src, f"{work}/partials", f"{work}/ckpt",
                             max_files_per_trigger=1)
    q.awaitTermination(300)
    assert q.exception() is None
    partials = spark.read.parquet(f"{work}/partials")
    assert partials.select("batch_id").distinct().count() >= 2
    got = user_day_from_partials(partials, read_table(spark, SF, "customer"))
    exp = user_day_from_events(events, read_table(spark, SF, "customer"))
    assert got.count() == exp.count() == 397
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
