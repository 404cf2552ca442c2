"""A stream of events gives the bars that the table of them gives, but for the hours that may still change."""

import datetime

from tidewick.streaming import bars


def test_stream_equals_table(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=17 * i), "click" if i % 3 else "view", float(i % 7)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    query = bars.stream_bars(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    table = {(r.symbol, r.bar_time): r for r in bars.hourly_bars(events).collect()}
    done = spark.read.schema(bars.hourly_bars(events).schema).parquet(str(tmp_path / "out")).collect()
    assert 0 < len(done) <= len(table) and all(table[r.symbol, r.bar_time] == r for r in done)
