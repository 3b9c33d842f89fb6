import numpy as np
import pytest

from polarity.functions.perfect_hash import PerfectHash
from polarity.operators.large_lexicon import LexiconArrays


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 1_000_000])
def test_keys_get_the_numbers_up_to_their_count(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    h = PerfectHash.build(keys)
    at = h.find(keys)
    assert np.array_equal(np.sort(at), np.arange(len(keys)))
    others = np.random.default_rng(7).integers(2**63, 2**64, 1000, dtype=np.uint64)
    found = h.find(others)
    assert ((found >= -1) & (found < max(len(keys), 1))).all()
    if n >= 1000:
        assert sum(b.nbytes for b in h.bits) * 8 < 5 * len(keys)


def test_million_entries():
    words = [f"w{i}" for i in range(1_000_000)]
    a = LexiconArrays.build(words, np.arange(1, 1_000_001) / 1e6, [("very", 0.5)], ["not"])
    from polarity.functions.word_runs import hashes_of
    texts = [["w9", "x", "w999999"], [], ["not", "w99"], ["very", "w0", "w1000000"]]
    hashes, edges = hashes_of(sum(texts, [])), np.cumsum([0, *map(len, texts)])
    s, p, n, k = a.sums(hashes, edges, 0.75, 3)
    assert np.allclose(s, [1e-5 + 1.0, 0, -0.75 * 1e-4, 0.5 + 1e-6]) and k.tolist() == [2, 0, 1, 1]


def test_workers_map_a_lexicon_and_look_up_slab_by_slab(spark, monkeypatch):
    """Beside its mapped file a worker holds arrays for one slab of a batch, not for all its tokens."""
    import pyarrow as pa
    from polarity.functions.word_runs import hashes_of
    from polarity.operators import large_lexicon as L
    words = [f"w{i}" for i in range(1000)]
    arrays = [LexiconArrays.build(words[k::2], np.arange(1, 501) * (-1.0) ** np.arange(500), [("very", 0.5)], ["not"]) for k in (0, 1)]
    files = [L.LexiconFile.share(spark.sparkContext, a) for a in (*arrays, LexiconArrays.build([], [], [], []))]
    for a, f in zip(arrays, files):
        b = f.mapped()
        assert (a.keys == b.keys).all() and (a.valence == b.valence).all() and not b.keys.flags.owndata and not b.keys.flags.writeable
    r = np.random.default_rng(1)
    rows = [[*r.choice([*words, "very", "not", "other", "é"], n), None][:n] for n in r.integers(0, 300, 500)]
    tokens = pa.array(rows, pa.list_(pa.string()))
    seen, real = [], L.word_hashes
    monkeypatch.setattr(L, "word_hashes", lambda points, *more: seen.append(len(points)) or real(points, *more))
    monkeypatch.setattr(L, "SLAB_BYTES", 5000)
    got = pa.Table.from_batches(L._add(files, ["c0"], 0.7, 3)(iter([pa.RecordBatch.from_arrays([pa.array(range(500)), tokens], names=["c0", "_tokens"])])))
    assert max(seen) <= 5000 + 1500 and got.column("c0").to_pylist() == list(range(500))
    assert got.column("_n_tokens").to_pylist() == [len(x) for x in rows]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    hashes = hashes_of([t or "" for x in rows for t in x])
    want = [x + y for x, y in zip(*(a.sums(hashes, edges, 0.7, 3) for a in arrays))]
    for name, w in zip("spnk", want):
        assert got.column("_sums").combine_chunks().field(name).to_pylist() == w.tolist()
