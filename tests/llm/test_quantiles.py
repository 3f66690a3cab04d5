import numpy as np

from loamworks.llm import quantiles as q


def test_merged_summaries_keep_their_stated_error():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(8, 2, 40_000), np.full(20_000, 500.0)])
    rng.shuffle(values)
    s = None
    for part in np.array_split(values, 13):
        p = q.compress(q.exact_summary(part), 500)
        s = p if s is None else q.compress(q.merge(s, p), 500)
    ordered = np.sort(values)
    for share in (0.01, 0.5, 0.9, 0.99):
        v, r = q.quantile(s, share), share * len(values)
        low, high = np.searchsorted(ordered, v, "left"), np.searchsorted(ordered, v, "right")
        assert low - q.rank_error(s) - 1 <= r <= high + q.rank_error(s) + 1


def test_small_groups_are_exact():
    s = q.exact_summary(np.array([3.0, 1.0, 2.0, 2.0]))
    assert q.rank_error(s) == 0
    assert [q.quantile(s, x) for x in (0.0, 0.5, 1.0)] == [1.0, 2.0, 3.0]


def test_merging_a_stream_of_many_small_summaries():
    rng = np.random.default_rng(2)
    merger, every = q._Merger(400), []
    for _ in range(300):
        part = rng.integers(0, 1000, rng.integers(1, 50)).astype(float)
        every.append(part)
        merger.add(q.exact_summary(part))
    s, ordered = merger.result(), np.sort(np.concatenate(every))
    assert s[2][-1] == len(ordered) and q.rank_error(s) <= 0.05 * len(ordered)
    for share in (0.05, 0.5, 0.95):
        v, r = q.quantile(s, share), share * len(ordered)
        assert np.searchsorted(ordered, v, "left") - q.rank_error(s) - 1 <= r <= np.searchsorted(ordered, v, "right") + q.rank_error(s) + 1


SCHEMA = "run_id long, arm string, run_condition string, duration_ms long, tool_calls int, started_at timestamp, recorded_at timestamp, value string"


def test_tables(spark):
    from datetime import datetime as t

    a, b = t(2026, 1, 1), t(2026, 1, 2)
    rows = [(i, "hot" if i % 3 else None, "cold", i % 50, None, a if i % 2 else b, a, "clash") for i in range(900)]
    rows += [(1, "hot", "cold", 10_000, 7, a, b, None), (None, "hot", "cold", 5, 5, a, a, None), (901, "hot", "warm", -1, None, a, a, None)]
    m = spark.createDataFrame(rows, SCHEMA)
    found = {(r.metric, r.arm, r.quantile): r for r in q.measured_percentiles(m).collect()}
    assert found["duration_ms", "hot", 0.5].n_values == 600 and found["duration_ms", None, 0.5].n_values == 300
    assert found["tool_calls", "hot", 0.5].value == 7.0 and ("duration_ms", "warm", 0.5) not in found
    combined = {(r.metric, r.arm, r.quantile): r.n_values for r in q.combined_days(m).collect()}
    assert combined == {k: r.n_values for k, r in found.items()}
    assert all(r.within_bound for r in q.bound_holds(m).collect())
    assert q.measured_percentiles(m.limit(0)).collect() == [] and q.bound_holds(m.limit(0)).collect() == []


def test_repeated_rows_that_differ_are_chosen_as_by_the_sql(spark):
    """One row of a run counts: of equal recorded_at the greatest values, day last, null before all."""
    from datetime import datetime as t

    import duckdb

    from loamworks.llm.catalog import ORACLE

    a, b = t(2026, 1, 1), t(2026, 1, 2)
    rows = [
        (1, "hot", "cold", 90, 1, a, a, None), (1, "hot", "cold", 10, 2, b, a, None),  # the later day has the smaller duration
        (2, None, "cold", 20, 3, a, a, None), (2, "hot", "cold", 30, 3, a, a, None),
        (3, "hot", None, 40, 4, a, a, None), (3, "hot", "cold", 50, 4, a, a, None),
        (4, "warm", "cold", None, 5, a, a, None), (4, "warm", "cold", 60, 6, a, a, None),
        (5, "hot", "late", 70, 7, a, None, None), (5, "hot", "cold", 80, 8, a, b, None),
        (6, "cool", "cold", 5, 9, a, a, None), (6, "cool", "cold", 5, 9, b, a, None),
    ]
    m = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE measurements (run_id BIGINT, arm VARCHAR, run_condition VARCHAR, duration_ms BIGINT, tool_calls INTEGER, started_at TIMESTAMP, recorded_at TIMESTAMP, value VARCHAR)")
    con.executemany("INSERT INTO measurements VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    by = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, q.bound_holds(m).collect()), key=by) == sorted(con.execute(ORACLE["p3_bound"]).fetchall(), key=by)

    expected = {
        ("duration_ms", "hot", "cold"): 90, ("duration_ms", None, "cold"): 20, ("duration_ms", "hot", None): 40, ("duration_ms", "hot", "late"): 70, ("duration_ms", "cool", "cold"): 5,
        ("tool_calls", "hot", "cold"): 1, ("tool_calls", None, "cold"): 3, ("tool_calls", "hot", None): 4, ("tool_calls", "warm", "cold"): 5, ("tool_calls", "hot", "late"): 7, ("tool_calls", "cool", "cold"): 9,
    }
    for found in (q.measured_percentiles(m), q.combined_days(m)):
        assert {(r.metric, r.arm, r.run_condition): r.value for r in found.where("quantile = 0.5").collect()} == expected
    assert {(r.metric, r.day) for r in q.measured_percentiles(m, by_day=True).where("arm = 'cool'").collect()} == {("duration_ms", b.date()), ("tool_calls", b.date())}
