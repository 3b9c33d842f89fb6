"""Split CSV against Spark's own multi-line reader, which reads a file in one task."""

import os
import random

import pytest

from polarity.sources import split_csv as S
from polarity.sources.files import read_text_csv, write_csv

SCHEMA = "id string, text string, more string"


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def to(n):
        for k in keys:
            spark.conf.set(k, str(n))

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(map(str, df.collect()))


def hostile(seed, n):
    """Lines whose quotes are doubled, stray, behind closing quotes, at ends and starts; fields with line breaks."""
    r = random.Random(seed)
    bits = ['""', "\n", ",", "a", " ", "é", "\r\n", "word", '""""', "\n\n", "x,y", '"",""']
    plain = ["", "a", 'in"side', "5' 6\"", " lead", 'a""b', "\\N", "ü"]
    field = lambda: '"' + "".join(r.choice(bits) for _ in range(r.randrange(6))) + '"' + r.choice(["", "", "", "", "tail", " "]) if r.random() < 0.5 else r.choice(plain)
    return "".join(f"{i},{field()},{field()}" + r.choice(["\n", "\n", "\n\n"]) for i in range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hostile_quoting_equals_the_multi_line_reader(spark, tmp_dir, small_ranges, seed):
    os.makedirs(f"{tmp_dir}/csv")
    for k in range(2):
        with open(f"{tmp_dir}/csv/{k}.csv", "w", newline="") as f:
            f.write('id,"te\nxt",more\n' + hostile(10 * seed + k, 120) + ('999,"open to the end\n,' if k else '998,"last, without a line break"'))
    want = rows_of(read_text_csv(spark, f"{tmp_dir}/csv", SCHEMA))
    for size in (64, 500, 1 << 20):
        small_ranges(size)
        got = read_text_csv(spark, f"{tmp_dir}/csv", SCHEMA, split=True)
        assert rows_of(got) == want, size
    small_ranges(64)
    assert spark.read.text(f"{tmp_dir}/csv").rdd.getNumPartitions() > 20


def test_what_is_written_comes_back(spark, tmp_dir, small_ranges):
    texts = [None, "", " ", "a\nb", 'say "x",\n"y"', "\n", '"', '""', ",", "\\N", "x" * 3000 + '\n"' + "y" * 3000, "\ta "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "id int, text string").coalesce(1)
    write_csv(df, f"{tmp_dir}/own")
    small_ranges(700)
    back = read_text_csv(spark, f"{tmp_dir}/own", "id int, text string", split=True)
    assert rows_of(back) == rows_of(read_text_csv(spark, f"{tmp_dir}/own", "id int, text string"))
    write_csv(df.limit(0), f"{tmp_dir}/none")
    assert read_text_csv(spark, f"{tmp_dir}/none", "id int, text string", split=True).collect() == []


def test_states_of_lines():
    for line, out, into in (("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('a"b,c', False, False), ('x",y"z', False, False), ("", False, True)):
        assert (S.ends_inside(line, False), S.ends_inside(line, True)) == (out, into), line
    assert S.ends_inside('"a""', False) and S.ends_inside('""', False) is False and S.ends_inside('""', True)
    assert S.ends_inside('x"', True) is False and S.ends_inside('x","y', True) and S.ends_inside('x"y"z', True) is False
    assert S.ends_inside('a,b,"c', False) and S.ends_inside('a,b",c', False) is False and S.ends_inside('"a"b,"c', False)
