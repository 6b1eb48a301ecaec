"""Type-1 upsert, incremental filter and incremental append against plain
Python on random tables."""
import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from maplift.operators.load import fact_incremental, incremental_filter, scd1_merge

T0 = dt.datetime(2024, 1, 1)


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(0, 9), max_size=30),
       st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9), st.integers(1, 5)), max_size=40))
def test_scd1_merge(spark, target, source):
    # versions unique per key in the source (latest wins without ties)
    src, seen = [], set()
    for k, v, ver in source:
        if (k, ver) not in seen:
            seen.add((k, ver))
            src.append((k, v, ver))
    t = spark.createDataFrame([(k, v, 0) for k, v in target.items()], "k int, v int, ver int")
    s = spark.createDataFrame(src, "k int, v int, ver int")
    want = {k: (v, 0) for k, v in target.items()}
    latest = {}
    for k, v, ver in src:
        if k not in latest or ver > latest[k][1]:
            latest[k] = (v, ver)
    want.update(latest)
    got = {r.k: (r.v, r.ver) for r in scd1_merge(t, s, ["k"], "ver").collect()}
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10 * 24 * 60), min_size=1, max_size=60, unique=True), st.data())
def test_incremental(spark, minutes, data):
    events = [(i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)]
    loaded = data.draw(st.lists(st.sampled_from(events), unique=True, max_size=len(events)))
    schema = "event_id int, ts timestamp_ntz"
    src, tgt = spark.createDataFrame(events, schema), spark.createDataFrame(loaded, schema)
    hi = max((ts for _, ts in loaded), default=None)
    loaded_ids = {i for i, _ in loaded}
    got = sorted(r.event_id for r in fact_incremental(src, tgt, "ts", ["event_id"], "2 days").collect())
    want = sorted(i for i, ts in events
                  if (hi is None or ts > hi - dt.timedelta(days=2)) and i not in loaded_ids)
    assert got == want
    got_f = sorted(r.event_id for r in incremental_filter(src, tgt, "ts", "ts").collect())
    assert got_f == sorted(i for i, ts in events if hi is None or ts > hi)
