import random
import zlib

from llm_rows import prose

from polarity.llm import toxicity as T


def corpus(n=600):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        sentences = [prose(1000 * i + k, r.randrange(3, 12), 60).capitalize() + "." for k in range(r.randrange(1, 15))]
        toxic = i % 5 == 0
        if toxic:
            k = r.randrange(len(sentences))
            sentences[k] = sentences[k][:-1] + " " + r.choice(["vilest", "rotten", f"grub{r.choice(['el', 'by', 'to', 'ing'])}"]) + "."
        rows.append((i, " ".join(sentences)))
        if i % 7:
            labels.append((i, int(toxic)))
    return rows, labels


def test_learns_and_locates(spark, edge_docs, no_docs):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int")
    model = T.train(docs, marks, usable=~T.held_out("id"))
    got = {r["doc_id"]: r for r in T.score(docs, model).withColumn("held", T.held_out()).collect()}
    assert {i: r["held"] for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    wrong = [i for i, r in got.items() if r["held"] and (r["score"] >= 0.5) != (i % 5 == 0)]
    assert len(wrong) <= 2
    for i, r in got.items():
        assert 0 <= r["score"] <= 1
        for place in r["offending"]:
            part = rows[i][1][place["start"]:place["start"] + place["length"]]
            assert part and any(w in part for w in ("vilest", "rotten", "grub")) or i in wrong or not r["held"]
    edge = T.score(edge_docs, model, carry=["id", "score", "text"])
    assert edge.count() == edge_docs.count()
    assert T.score(edge_docs, model, carry=["doc_id"]).filter("doc_id IN (1, 2, 3) AND score != 0").count() == 0
    assert T.score(no_docs, model).collect() == []


def test_one_class_or_no_labels_scores_zero(spark, edge_docs):
    for rows in ([], [(8, 1), (9, 1)]):
        model = T.train(edge_docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r["score"] for r in T.score(edge_docs, model, carry=["doc_id"]).select("score").distinct().collect()] == [0.0]


def test_noisy_or_is_the_union_of_sentences(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    two = spark.createDataFrame([(1, "Ab vilest cd."), (2, "Ef rotten gh."), (3, "Ab vilest cd. Ef rotten gh.")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in T.score(two, model).collect()}
    assert abs((1 - s[3]) - (1 - s[1]) * (1 - s[2])) < 1e-6


def test_every_word_of_a_broad_vocabulary_counts(spark):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1000)]
    rows = [(i, prose(i, 12, 60).capitalize() + (f". Ab {' '.join(words[(4 * i + k) % 1000] for k in range(4))} cd." if i % 3 == 0 else ".")) for i in range(3000)]
    model = T.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    alone = spark.createDataFrame([(k, f"Ab {w} cd.") for k, w in enumerate(words)], "doc_id long, text string")
    used = {w for i, t in rows if i % 3 == 0 for w in t.split()}
    missed = [w["doc_id"] for w in T.score(alone, model).filter("score < 0.5").collect() if words[w["doc_id"]] in used]
    assert len(used & set(words)) > 300 and missed == []


def test_the_gradient_is_the_slope_of_the_noisy_or_loss():
    import math
    from types import SimpleNamespace

    import numpy as np
    docs = [(1, [[0, 2], [1]], 1), (0, [[2]], 0), (1, [], 2), (0, [[0], [1, 2], [0, 1]], 3), (1, [[3]], 0)]  # label, features of sentences, plain sentences
    w = np.array([0.4, -1.1, 0.7, 1.9, -0.8])  # the bias last

    def loss(w):
        total = 0.0
        for label, sentences, plain in docs:
            clean = math.prod(1 - 1 / (1 + math.exp(-(w[-1] + sum(w[f] for f in s)))) for s in [*sentences, *[[]] * plain])
            total -= math.log(1 - clean) if label else math.log(clean)
        return total

    of, s, feature = [], [], []
    for d, (_, sentences, _) in enumerate(docs):
        for fs in sentences:
            s += [len(of)] * len(fs)
            feature += fs
            of.append(d)
    row = tuple(np.array(x, np.int32).tobytes() for x in ([d[0] for d in docs], [d[2] for d in docs], of, s, feature))
    got = next(T._gradient(SimpleNamespace(value=w))(iter([row])))
    step = 1e-6
    for k in range(len(w)):
        e = np.eye(len(w))[k] * step
        assert abs(got[k] - (loss(w + e) - loss(w - e)) / (2 * step)) < 1e-5


def test_scores_equal_a_plain_noisy_or(spark):
    import math

    import numpy as np
    import pyarrow as pa

    from polarity.llm.words import ALNUM, Words, text_buffer
    texts = ["One bad day. A good one! Bad bad bad?", "", None, "nothing here", "bad\nworse. x", "Good. " * 40 + "bad"]
    model = T.Model(np.zeros(1 << T.HASH_BITS, dtype=np.float32), -3.0)
    rng = np.random.default_rng(1)
    model.weights[rng.integers(0, len(model.weights), len(model.weights) // 2)] = 0.5
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["score"] for r in T.score(df, model, carry=["id"]).collect()}
    for i, t in enumerate(texts):
        words = Words(*text_buffer(pa.array([t], pa.string())), ALNUM, lower=True)
        feature, sentence, first = T._features(words)
        clean = 1.0
        for s in range(len(first)):
            x = model.bias + sum(float(model.weights[f]) for f in {int(f) for f, n in zip(feature, sentence) if n == s})
            clean *= 1 - 1 / (1 + math.exp(-x))
        assert abs(got[i] - (1 - clean)) < 1e-9
