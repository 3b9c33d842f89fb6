import hashlib
import re

from llm_rows import prose
from pyspark.sql import functions as F

from polarity.llm.decontaminate import contamination, covered


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=10):
    windows, sizes = {}, set()
    for i, t in items:
        w = words(t)
        if w:
            m = min(n, len(w))
            sizes.add(m)
            for k in range(len(w) - m + 1):
                windows.setdefault(tuple(w[k:k + m]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, of = words(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    hit.update(range(k, k + m))
                    of |= windows[tuple(w[k:k + m])]
        out.append((i, len(w), len(hit), sorted(of)))
    return sorted(out, key=str)


def found(docs, items, **kw):
    return sorted((tuple(r) for r in contamination(docs, items, **kw).select("doc_id", "n_words", covered().alias("n"), "items").collect()), key=str)


def test_matches_brute_force(spark, edge_docs, edge_rows):
    long = edge_rows[15][1].split()
    items = [(1, " ".join(long[500:540])), (2, " ".join(long[29_985:])), (3, "One"), (4, "b, C"), (None, edge_rows[7][1]), (6, None), (7, "  "), (8, prose(99, 30)),
             (9, " ".join(long[520:530])), (9, " ".join(long[520:530])), (10, "É Ü " + prose(8, 9)), (11, "same same same same same same same same same same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r[0], r[1]) for r in edge_rows], items)
    assert found(edge_docs, bench) == want
    assert sum(w[2] > 0 for w in want) >= 8


def test_every_shared_span_of_ten_words_is_found(spark):
    item = prose(1, 80).split()
    docs = [(k, " ".join([*prose(k + 5, 7).split(), *item[k:k + 10], *prose(k + 500, 6).split()])) for k in range(71)]
    docs += [(100 + k, " ".join([*prose(k + 5, 7).split(), *item[k:k + 9], *prose(k + 500, 6).split()])) for k in range(71)]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("i", " ".join(item))], "item_id string, text string"))
    assert [r[2] for r in got if r[0] < 100] == [10] * 71
    assert {r[2] for r in got if r[0] >= 100} == {0}


def test_empty_tables(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_docs, none).collect() == []
    assert contamination(edge_docs, none).filter(F.size("spans") > 0).count() == 0


def test_query_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
