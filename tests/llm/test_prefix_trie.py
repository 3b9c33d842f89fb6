import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from polarity.llm import prefix_trie as P
from polarity.llm.scratch import scratch_scope

SCHEMA = "conv_id long, turn long, role string, text string, pos int, a string, node string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), role or "", text or ""))
    own = {c: [t[4:] for t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(n))))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "a", "n") for r in rows], SCHEMA).repartition(parts)
    conv = F.col("conv")
    with scratch_scope(spark) as keep:
        done = keep(P.prefix_trie(P.mixed_turns(P.ordered_turns(df), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)))
    return sorted((tuple(r) for r in done.collect()), key=str)


def talks(seed, n, words="ab", longest=7):
    r = random.Random(seed)
    out = []
    for c in range(n):
        c = r.choice([c, c, -c, 1000 * c])
        for t in range(r.randrange(longest)):
            out.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice([*words, None, "ü" * 40 + words[t % len(words)]])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = talks(seed, 260)
    rows += [(None, 1, "user", "x"), (5, 1, "user", "y"), (5, 1, "user", "y")]
    assert trie(spark, rows) == brute(rows)


def test_a_small_sketch_is_only_slower(spark, monkeypatch):
    rows = talks(3, 150, "abcdefgh")
    want = brute(rows)
    monkeypatch.setattr(P, "LEAST_CELLS", 2)
    monkeypatch.setattr(P, "MOST_CELLS", 64)
    assert trie(spark, rows) == want
    monkeypatch.setattr(P, "RUN_IDS", 2)
    monkeypatch.setattr(P, "HOT_PARTS", 4)
    assert trie(spark, rows) == want


def test_copies_long_conversations_and_empty_table(spark):
    rows = [(7, k if k % 3 else None, "user", f"t{k % 11}") for k in range(400)] + [(c, k, "user", f"s{k}") for c in range(300, 360) for k in range(6)]
    rows += [(8, k, "user", "same") for k in range(50)] + [(8, 3, None, None)] * 40
    got = trie(spark, rows)
    assert got == brute(rows)
    assert trie(spark, []) == []


def test_texts_that_begin_alike_keep_their_order_over_ranges(spark):
    start = "s" * 32
    rows = [(1, 1, "user", start + "x" * (k % 3)) for k in range(60)] + [(1, 1, "u" * (32 + k % 2), start[:30 + k % 5]) for k in range(40)]
    assert trie(spark, rows) == brute(rows)
