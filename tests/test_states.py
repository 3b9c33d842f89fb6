import datetime as dt
import random

from pyspark.sql import functions as F

from polarity.operators import states as S
from polarity.operators.windows import daily_series


def test_quantile_states_merge_to_any_period(spark):
    r = random.Random(2)
    rows = [("ab"[i % 2], i % 7, r.gauss(0, 1) if i % 50 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(4)
    states = S.quantile_states(df, ["g", "day"], "v")
    for some in (range(7), range(3)):
        got = S.quantiles(S.merge_quantiles(states.filter(F.col("day").isin(*some)), ["g"]), {"q1": 0.25, "m": 0.5}).collect()
        for x in got:
            values = sorted(v for g, d, v in rows if g == x.g and d in some and v is not None)
            assert x.n == len(values)
            for q, rank in ((x.q1, 0.25), (x.m, 0.5)):
                assert abs(sum(v <= q for v in values) / len(values) - rank) < 0.01
    assert S.quantile_states(df.limit(0), ["g"], "v").collect() == []


def test_three_landings_give_the_batch_result_and_write_only_touched_days(spark, tmp_dir):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=3)
    first = [(e, day(d), float(d + len(e))) for e in ("a", "bb") for d in range(20) if d not in (4, 11)]
    late = [("a", day(4), 50.0), ("a", day(4), None), ("c", day(19), 1.0)]
    more = [("bb", day(2), 9.0), (None, day(30), 2.0)]
    kind, again = "e string, t timestamp, v double", []
    for batch, rows in enumerate((first, late, more, more)):  # the last landing is run twice
        dates = S.add_landing(spark.createDataFrame(rows, kind), f"{tmp_dir}/s", min(batch, 2), "e", "t", "v", 3)
        again.append({r.date.day for r in dates.collect()})
    assert again[1] == {5, 6, 7, 20} and again[2] == again[3] == {3, 4, 6, 31}  # day 5 has no row of bb, so its window goes on to day 6
    whole = daily_series(spark.createDataFrame(first + late + more, kind), "t", ["v"], ["e"], 3)
    key = lambda r: (r[0] or "", r[1])
    want = sorted(((r.e, r.date, r.v, r.v_rolling) for r in whole.collect()), key=key)
    got = sorted(((r.entity, r.date, r["mean"], r.rolling) for r in S.series(spark, f"{tmp_dir}/s").collect()), key=key)
    assert got == want
