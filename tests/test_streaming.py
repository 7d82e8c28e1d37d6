import datetime as dt

import pytest

from arbora.lang.macros import fill
from arbora.streaming import events


@pytest.fixture
def source(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    data = [(1, at(1), "a", 1.0), (1, at(2), "a", 2.0), (2, at(3), "b", 5.0), (1, at(14), "b", 3.0), (2, at(15), "a", 6.0)]
    spark.createDataFrame(data, "user long, ts timestamp, kind string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    return events.read(spark, str(tmp_path / "in"), "user long, ts timestamp, kind string, value double")


def collect(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_windows(spark, source):
    got = collect(spark, events.windowed_counts(source, "ts", ["kind"], "10 minutes"), "w", "complete")
    assert sorted((r.start.minute, r.kind, r.n) for r in got) == [(0, "a", 2), (0, "b", 1), (10, "a", 1), (10, "b", 1)]


def test_previous_row_by_state(spark, source):
    got = collect(spark, events.previous(source, "user", "ts", "value"), "p", "append")
    assert sorted((r.user, r.value, r.previous) for r in got if r.previous is not None) == [(1, 2.0, 1.0), (1, 3.0, 2.0), (2, 6.0, 5.0)]
    assert sorted(r.user for r in got if r.previous is None) == [1, 2]


def test_stored_query_parameters():
    assert fill("n > $(low,3) && k == $(k)", {"k": 1}) == "n > 3 && k == 1"
    with pytest.raises(ValueError):
        fill("$(x)", {})
