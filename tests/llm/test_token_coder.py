"""Range coder: exact round trips, independent blocks, checksums."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polarity.llm.token_coder import decode, encode

V = 50_257


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, V - 1), max_size=600), st.integers(1, 40), st.integers(3, 300))
def test_round_trip(ids, repeat, block):
    ids = np.array(ids * repeat, dtype=np.int64)[:5000]
    assert (decode(encode(ids, V, block), V) == ids).all()


@pytest.mark.parametrize("ids", [np.zeros(9000, int), np.arange(9000), np.random.default_rng(1).zipf(1.3, 20_000) % V,
                                 np.tile(np.random.default_rng(2).integers(0, V, 40), 300)])
def test_round_trip_of_long_streams(ids):
    assert (decode(encode(ids, V), V) == ids).all()


def test_predictable_streams_shrink():
    ids = np.tile(np.random.default_rng(2).integers(0, V, 40), 300)
    assert sum(len(w) for _, _, w in encode(ids, V)) < len(ids) / 4


def test_blocks_are_independent():
    ids = np.random.default_rng(5).zipf(1.2, 3000) % V
    blocks = encode(ids, V, 1000)
    assert (decode(blocks[1:2], V) == ids[1000:2000]).all()


def test_damage_is_found():
    n, crc, words = encode(np.random.default_rng(5).zipf(1.2, 3000) % V, V)[0]
    damaged = bytes([words[40] ^ 1])
    with pytest.raises(ValueError, match="checksum"):
        decode([(n, crc, words[:40] + damaged + words[41:])], V)


def test_ids_that_need_two_words_a_step():
    ids = np.random.default_rng(7).integers(0, 1 << 16, 30_000)
    ids[9000:12_000] = 65_535
    assert (decode(encode(ids, 1 << 16), 1 << 16) == ids).all()


def test_ids_seen_again_cost_less_than_new_ones():
    r = np.random.default_rng(8)
    few = sum(len(w) for _, _, w in encode(r.choice(r.integers(0, V, 20), 20_000), V))
    assert few < sum(len(w) for _, _, w in encode(r.integers(0, V, 20_000), V)) / 2.5


def test_blocks_whose_counts_would_not_fit_are_refused():
    with pytest.raises(ValueError, match="at most"):
        encode(np.zeros(10, int), V, 1 << 16)


def test_an_id_takes_few_calls(monkeypatch):
    """A step of all blocks looks up each table once: the calls depend on the steps, not on the blocks."""
    from polarity.llm import token_coder as C
    calls = []
    predict = C._Model.predict
    monkeypatch.setattr(C._Model, "predict", lambda self: calls.append(1) or predict(self))
    ids = np.random.default_rng(9).zipf(1.3, 64 * C.BLOCK) % V
    assert (decode(encode(ids, V), V) == ids).all()
    assert len(calls) == 2 * C.BLOCK <= 2 * 1024
