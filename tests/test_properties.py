"""Property tests: library results equal brute-force Python on random frames."""

import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pkgpulse.operators.keys import dense_index
from pkgpulse.operators.upsert import keep_last, upsert
from pkgpulse.plans import reports
from pkgpulse.schemas import REQUESTS_BY_DATE
from tests.helpers import BY_DATE, PACKAGES, rows

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
BASE = dt.date(2024, 1, 1)

fact_rows = st.lists(
    st.tuples(
        st.integers(1, 4),  # package_id
        st.integers(1, 3),  # client_type_id
        st.integers(0, 40),  # day offset
        st.integers(0, 50),  # request_count
    ),
    min_size=1,
    max_size=60,
    unique_by=lambda r: r[:3],
)


def _fact(spark, data):
    return spark.createDataFrame([(p, c, BASE + dt.timedelta(days=d), n) for p, c, d, n in data], BY_DATE)


@SETTINGS
@given(old=fact_rows, new=fact_rows)
def test_upsert_matches_dict_update(spark, old, new):
    target, batch = _fact(spark, old), _fact(spark, new)
    expect = {r[:3]: r[3] for r in old}
    expect.update({r[:3]: r[3] for r in new})
    once = upsert(target, batch, REQUESTS_BY_DATE.keys)
    got = {(p, c, (d - BASE).days): n for p, c, d, n in rows(once)}
    assert got == expect
    assert rows(upsert(once, batch, REQUESTS_BY_DATE.keys)) == rows(once)


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 1000), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=50, unique_by=lambda r: r[1]))
def test_keep_last_is_max_by_order(spark, data):
    df = spark.createDataFrame(data, "k int, o int, v bigint")
    best = {}
    for k, o, v in data:
        if k not in best or o > best[k][0]:
            best[k] = (o, v)
    assert rows(keep_last(df, ["k"], ["o"], ["v"])) == sorted((k, v) for k, (o, v) in best.items())


@SETTINGS
@given(keys=st.sets(st.text("abcdef", min_size=1, max_size=6), min_size=1, max_size=80), start=st.integers(1, 10**6), parts=st.integers(1, 9))
def test_dense_index_bijection(spark, keys, start, parts):
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(parts)
    got = rows(dense_index(df, "k", start=start, id_col="id"), "k", "id")
    assert got == [(k, start + i) for i, k in enumerate(sorted(keys))]


@SETTINGS
@given(data=fact_rows)
def test_kpis_monotone_and_exact(spark, data):
    k = reports.request_kpis(_fact(spark, data), client_types=(1, 2, 3)).first()
    asof = max(d for _, _, d, _ in data)

    def window(days):
        return sum(n for _, _, d, n in data if d > asof - days)

    assert (k.past_day_requests, k.past_week_requests, k.selected_timeframe_requests) == (window(1), window(7), window(30))
    assert k.past_day_requests <= k.past_week_requests <= k.selected_timeframe_requests


@SETTINGS
@given(
    data=st.lists(
        st.tuples(st.integers(1, 3), st.integers(1, 2), st.integers(0, 27), st.integers(0, 30)),
        min_size=20,
        max_size=120,
        unique_by=lambda r: r[:3],
    )
)
def test_trending_matches_brute_force(spark, data):
    data = data + [(3, 1, 27, 0)]  # pins the as-of date to day 27
    data = list({r[:3]: r for r in data}.values())
    fact = _fact(spark, data)
    pk = spark.createDataFrame([(1, "u1", "A"), (2, "u2", "B"), (3, "u3", "C_jll")], PACKAGES)
    got = {r.package_name: r.percent_change for r in reports.trending_packages(fact, pk, client_types=(1, 2), min_rows=3, daily_minimum=2).collect()}
    asof = 27
    names = {1: "A", 2: "B", 3: "C_jll"}
    last, prev = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for p, c, d, n in data:
        if n <= 2 or names[p].endswith("jll"):
            continue
        if asof - 14 <= d <= asof:
            last[p][0] += n
            last[p][1] += 1
        if asof - 27 <= d <= asof - 14:
            prev[p][0] += n
            prev[p][1] += 1
    expect = {}
    for p in last:
        l, lr = last[p]
        pv, pr = prev[p]
        if lr > 3 and pr > 3 and l > pv:
            expect[names[p]] = ((20000 * (l - pv) + pv) // (2 * pv)) / 100.0
    assert got == expect


def test_hot_package_is_combined_before_the_shuffle(spark):
    """One package with a third of the rows: partial sums happen map-side."""
    hot = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("u1")).otherwise(F.concat(F.lit("u"), (F.col("id") % 50 + 2).cast("string"))).alias("package_uuid"),
        F.lit("user").alias("client_type"),
        F.lit(200).alias("status"),
        F.lit("EU").alias("region"),
        (F.lit(BASE) + (F.col("id") % 30).cast("int")).alias("date"),
        F.lit(1).cast("bigint").alias("request_addrs"),
        F.lit(1).alias("request_count"),
    )
    from pkgpulse.operators.ingest import ingest_requests_by_date
    from pkgpulse.sources.registry import client_types_frame

    pk = spark.createDataFrame([(i, f"u{i}", f"P{i}") for i in range(1, 53)], PACKAGES)
    out = ingest_requests_by_date(hot, pk, client_types_frame(spark))
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    text = buf.getvalue()
    assert "partial_sum" in text and text.index("partial_sum") > text.index("Exchange hashpartitioning")
    total = {r.date: r.s for r in out.where("package_id = 1").groupBy("date").agg(F.sum("request_count").alias("s")).collect()}
    assert sum(total.values()) == 10000
