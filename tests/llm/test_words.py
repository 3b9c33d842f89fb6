"""Words, hashes and runs over Arrow buffers against Python's own."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from polarity.llm.words import ALNUM, NOT_BLANK, Words, grams, inside_rows, pieces, sliding_min, text_buffer

TEXT = st.text(alphabet="ab é\n\tü0-  A.", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_match_regex(texts):
    for table, pattern, lower in ((NOT_BLANK, rb"[^\x20\x09-\x0D]+", False), (ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        buf, offsets = text_buffer(pa.array(texts, pa.string()))
        words = Words(buf, offsets, table, lower)
        got = [[words.buf[s:e].tobytes() for s, e in zip(words.starts[a:b], words.ends[a:b])] for a, b in zip(words.first, words.first[1:])]
        low = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()) if lower else (t or "").encode()
        assert got == [re.findall(pattern, low(t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é"]), max_size=12), min_size=1, max_size=5), st.integers(1, 4))
def test_equal_runs_have_equal_hashes(rows, n):
    buf, offsets = text_buffer(pa.array([" ".join(r) for r in rows], pa.string()))
    words = Words(buf, offsets, NOT_BLANK, False)
    start, row = inside_rows(words, n)
    want = [(i, tuple(r[k:k + n])) for i, r in enumerate(rows) for k in range(len(r) - n + 1)]
    assert row.tolist() == [i for i, _ in want]
    h = grams(words.hashes(), n)[start] if len(start) else []
    assert len({w for _, w in want}) == len(set(map(int, h)))
    assert len({(w, int(x)) for (_, w), x in zip(want, h)}) == len(set(map(int, h)))


def test_sliding_min():
    x = np.random.default_rng(3).integers(0, 50, 200)
    for n in (1, 2, 5, 8, 32, 33):
        assert sliding_min(x, n).tolist() == [x[i:i + n].min() for i in range(len(x) - n + 1)]


def test_pieces_keep_rows_whole_and_take_slices():
    batch = pa.record_batch({"text": pa.array(["x" * 50, None, "", "é" * 30, "z"])}).slice(1)
    seen = [(rows.num_rows, buf.tobytes().decode()) for rows, buf, _ in pieces(iter([batch]), "text", 10)]
    assert sum(n for n, _ in seen) == 4
    assert "".join(t for _, t in seen) == "é" * 30 + "z"


def test_a_pass_gives_memory_back_when_its_task_ends():
    """What the allocators of a worker keep free is the machine's again."""
    import numpy as np
    import pyarrow as pa
    from polarity.llm.scratch import lean, lean_group

    def held():
        return next(int(x.split()[1]) >> 10 for x in open("/proc/self/status") if x.startswith("RssAnon"))

    def run(batches):
        for n in batches:
            arrays = [np.ones(1 << 12) for _ in range(n)]  # 32 KB each, from the heap
            last = np.ones(1 << 10)
            del arrays
            yield last

    before = held()
    out = list(lean(run)(iter([4000, 4000])))
    assert [x.sum() for x in out] == [1024.0, 1024.0] and held() - before < 40
    table = pa.table({"a": [1, 2]})
    assert lean_group(lambda t: t.slice(1))(table).to_pylist() == [{"a": 2}]
