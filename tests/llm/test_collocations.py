import random
import re
from collections import Counter

from llm_rows import prose

from polarity.llm import collocations as C
from polarity.llm.scratch import scratch_scope


def brute(rows, least=10, covered=50, first=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:i + 2] for p, a in found.items() if len(p) == 3 for i in (0, 1) if 100 * a >= covered * counts[p[i:i + 2]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def texts(seed, n, words=30):
    r, out = random.Random(seed), []
    lines = [" ".join(f"l{k}w{j}" for j in range(k + 1)) for k in range(12)]
    for _ in range(n):
        parts = [r.choice([*lines, " ".join(f"W{min(r.randrange(words), r.randrange(words))}" for _ in range(r.randrange(9)))]) for _ in range(6)]
        out.append((r.choice([". ", ", ", "\n", " ", "  ", "\t", "! ? "]).join(parts), r.choice(["en", "de", None])))
    return out + [(None, "en"), ("", None), (" .,;\n", "fr"), ("é É à", "fr"), ("one", "fr"), ("und", "und")]


def found(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, x int, word string, f int").repartition(parts)
    return sorted(tuple(r) for r in C.collocations(df, **more).collect())


def test_random_texts(spark):
    rows = texts(1, 500)
    want = brute(rows)
    assert len(want) > 150 and {len(r[2].split()) for r in want} == {2, 3}
    assert found(spark, rows) == want
    assert found(spark, rows, least=3, covered=80, first=40) == brute(rows, 3, 80, 40)


def test_hot_words_and_nodes_are_dealt_apart(spark, monkeypatch):
    rows = texts(2, 200) + [(f"a b x{k % 70} y{k % 9} a b", "en") for k in range(400)]
    monkeypatch.setattr(C, "SAMPLE", 1)
    monkeypatch.setattr(C, "HOT_SHARE", 100)
    monkeypatch.setattr(C, "CHUNK_WORDS", 700)
    assert found(spark, rows, 2) == brute(rows)


def test_paths_and_an_empty_table(spark):
    rows = [("p q r s t u. v", "en")] * 12 + [("r s x", "en")] * 3 + [("v p q r", "en")] * 2
    df = spark.createDataFrame(rows, "text string, lang string")
    with scratch_scope(spark):
        graph = C.word_graph(df)
        names = dict((r["x"], r["word"]) for r in graph["names"].collect())
        paths = {(" ".join(names[w] for w in r["words"]), r["f"]) for r in C.compact_paths(graph["edges"], graph["nodes"]).collect()}
    assert paths == {("p q r", 14), ("q r s", 12), ("r s t u", 12)}
    assert found(spark, []) == []
    assert found(spark, [(prose(1, 50), None), (None, None)]) == []
