import hashlib

from llm_rows import prose
from pyspark.sql import functions as F

from polarity.llm import multiset as M


def edited(rows):
    """Brute force: (id, text) in order of id (nulls first) and text -> (id, edited text)."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    return out


def test_edited_texts_match_brute_force(spark, edge_docs, edge_rows, no_docs):
    got = [tuple(r)[:3] for r in M.edited_fingerprints(edge_docs).collect()]
    assert sorted(got, key=str) == sorted(edited([(r[0], r[1]) for r in edge_rows]), key=str)
    rows = [(k * k * 1000 - 5 * 10**9, f"text {k} é" * (k % 7)) for k in range(300)] + [(9_000_000_000_000_000, "far"), (-9_000_000_000_000_000, "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(tuple(r)[:3] for r in M.edited_fingerprints(df).collect()) == sorted(edited(rows))
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in M.edited_fingerprints(one).collect()] == edited([(5, "abcdef")])
    assert M.edited_fingerprints(no_docs).collect() == []


def prints(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r[0] for r in df.withColumn("v", M.lanes(M.paragraphs(F.col("text")))).orderBy("k").select("v").collect()]


def test_sums_ignore_order_and_count_copies(spark):
    a, b, ab, ba, aab, none, blank = prints(spark, ["One line", "another line", "One line\nanother line", "another line\n\n One line ", "One line\nOne line\nanother line", None, " \n "])
    assert ab == ba != aab and none == blank == [0] * (M.EXACT + M.SIGNS)
    df = spark.createDataFrame([(a, b, ab, aab)], "a array<long>, b array<long>, ab array<long>, aab array<long>")
    got = df.select(M.combine(F.col("a"), F.col("b")), M.combine(F.col("aab"), F.col("a"), -1), M.combine(M.combine(F.col("ab"), F.col("a"), -1), F.col("b"), -1)).first()
    assert got[0] == ab and got[1] == ab and got[2] == [0] * len(a)


def test_likeness(spark):
    half = [prose(k, 12) + "." for k in range(40)]
    rows = [(1, " ".join(half)), (2, " ".join(half[:20] + [prose(k + 900, 12) + "." for k in range(20)])), (3, " ".join(prose(k + 500, 12) + "." for k in range(40))), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("v", M.lanes(M.paragraphs(F.col("text"))))
    pairs = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.id"), F.col("b.id"), M.likeness(F.col("a.v"), F.col("b.v"))).collect()
    like = {(r[0], r[1]): r[2] for r in pairs}
    assert all(like[k, k] == 1 for k in range(1, 6)) and like[4, 5] == 1 and like[1, 4] == 0
    assert 0.3 < like[1, 2] < 0.7 and like[1, 3] < 0.3
    text = df.select(M.as_text(F.col("v"))).distinct().collect()
    assert len(text) == 4 and {len(r[0]) for r in text} == {M.EXACT * 8 + M.SIGNS * 5}


def test_plan_has_no_python(edge_docs):
    plan = M.edited_fingerprints(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
