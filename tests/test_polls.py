import datetime as dt

from polarity.streaming import polls as P

KIND = "url string, at timestamp, text string"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def poll(days):
    return [(f"u{d}-{k}", at(d), f"t{d}") for d in days for k in range(3)]


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_overlapping_polls_equal_the_distinct_batch_also_after_a_restart(spark, tmp_dir):
    polls = [poll(range(10)) + poll([3]), poll(range(5, 14)) + [("u2-0", at(9), "again"), (None, at(9), "x"), ("y", None, "z")], poll(range(1, 18))]
    for batch in (0, 1, 1, 0, 2):  # the first two are run again
        P.take_poll(spark.createDataFrame(polls[batch], KIND), f"{tmp_dir}/p", batch, "url", "at", 7)
    got = P.collected(spark.range(1), f"{tmp_dir}/p")
    assert rows_of(got, "url", "at", "text") == sorted(poll(range(18)))
    late = P.collected(spark.range(1), f"{tmp_dir}/p", "rejects")
    assert sorted(map(str, rows_of(late.fillna("-"), "url", "reason"))) == sorted(map(str, [("-", P.NO_KEY), ("y", P.NO_KEY)] + [(u, P.LATE) for u, _, _ in poll(range(1, 6))]))


def test_stream_of_landed_files(spark, tmp_dir):
    for k, days in enumerate((range(4), range(2, 6))):
        spark.createDataFrame(poll(days), KIND).coalesce(1).write.mode("append").json(f"{tmp_dir}/land")
        stream = spark.readStream.schema(KIND).json(f"{tmp_dir}/land")
        P.collect_polls(stream, f"{tmp_dir}/p", f"{tmp_dir}/check", "url", "at", 7).awaitTermination()
    assert rows_of(P.collected(spark.range(1), f"{tmp_dir}/p"), "url", "at", "text") == sorted(poll(range(6)))
