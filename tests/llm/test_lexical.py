"""Block-max search against scoring of every document."""

import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from messy import frame, messy_rows  # noqa: E402

from pathgram.llm import lexical  # noqa: E402
from pathgram.llm.lexical import build_index, build_shard, search  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(d, Counter(cut(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for name, text in items:
        found = []
        for (d, c), n in zip(held, sizes):
            score = 0
            for term in cut(text):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * c[term] // (1000 * c[term] + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(name, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return out


def got(index, items, **more):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search(index, items, **more).collect()), key=str)


def table(spark, items, parts=2):
    return spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string").repartition(parts)


ITEMS = [(1, "alpha BETA gamma"), (2, "alpha alpha alpha x"), (3, None), (4, ""), (5, "nothing that is there, zzz"), (6, "日本語 İstanbul été naïve"),
         (7, "a b c d e one two three"), (8, "no id here hi"), (9, "42 3.14 5 tag"), (9, "x y"), (10, " ".join("alpha beta gamma x don t été straße".split() * 40))]


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 24])
def test_every_rank_and_score(spark, shard_bytes):
    docs = frame(spark)
    index = build_index(docs, shard_bytes=shard_bytes)
    assert got(index, table(spark, ITEMS)) == sorted(brute([(d, t) for d, t, _ in messy_rows()], ITEMS), key=str)


def crowd(n, seed):
    """Documents over a skewed vocabulary: frequent words in most of them, long lists of many blocks, large groups of copies."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    copy = "w1 w2 w3 w200 w200 w350"
    return [(k, copy if k % 3 == 0 else " ".join(rng.choices(words, weights, k=rng.choice([3, 10, 40, 200])))) for k in range(n)], rng, words, weights


@pytest.mark.parametrize("wide", [False, True])
def test_long_lists_and_copies(spark, monkeypatch, wide):
    if wide:  # as with more wanted terms than may be broadcast, in several groups of items
        monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lexical, "ASKED", 1)
    docs, rng, words, weights = crowd(2500, 3)
    items = [(k, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30])))) for k in range(25)] + [(99, "w1 w200 w350 w3")]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_bytes=40_000)
    assert got(index, table(spark, items), group=10 if wide else 512) == sorted(brute(docs, items), key=str)


def test_search_opens_few_blocks(spark):
    """Bounds reject blocks: a search that asks for a rare and a frequent term opens less than all of the frequent list."""
    docs, *_ = crowd(6000, 4)
    docs += [(90_000 + k, "rare w0 w0 w0") for k in range(30)]
    rows = build_shard(0, pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs]))
    head = rows[0]
    n_docs, n_terms = head[2], head[3]
    sizes = np.frombuffer(head[8], "<u4").astype(np.int64)
    scale = 75 + 25 * sizes * n_docs // n_terms
    lists = {}
    for row in rows[1:]:
        peak_ends, body_ends = np.frombuffer(row[7], "<u4"), np.frombuffer(row[9], "<u4")
        for k, term in enumerate(row[4].split(b" ")):
            a, c = (int(peak_ends[k - 1]), int(body_ends[k - 1])) if k else (0, 0)
            lists[term] = lexical.Postings(row[6][20 * a : 20 * int(peak_ends[k])], row[8][c : int(body_ends[k])], scale,
                                           lambda tf, n: 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * n_docs // n_terms)))
    held = {t: {} for t in (b"w0", b"rare", b"w7")}
    for k, (_, text) in enumerate(docs):
        for t in held:
            if n := cut(text).count(t.decode()):
                held[t][k] = 1_000_000_000 * n // (1000 * n + 12 * int(scale[k]))
    for t, want in held.items():  # round trip, and maxima that are met
        doc, value = lists[t].whole()
        assert dict(zip(doc.tolist(), value.tolist())) == want
        assert all(int(lists[t].open(b)[1].max()) == int(lists[t].top[b]) for b in range(len(lists[t].first)))
    fresh = {t: lexical.Postings.__new__(lexical.Postings) for t in held}
    for t, p in fresh.items():
        p.__dict__.update(lists[t].__dict__, opened={}, all=None)
    heap = lexical.Heap(20)
    lexical.search_shard(heap, [(10, fresh[b"w0"]), (4000, fresh[b"rare"])], np.arange(len(docs)), np.ones(len(docs), bool))
    assert len(heap.rows) == 20 and len(fresh[b"w0"].opened) < len(fresh[b"w0"].first) / 4


def test_nothing(spark):
    docs = frame(spark, [])
    assert got(build_index(docs), table(spark, ITEMS)) == []
    blank = spark.createDataFrame([(1, None), (2, " ..,")], "doc_id long, text string")
    assert got(build_index(blank), table(spark, ITEMS)) == []
    assert got(build_index(frame(spark)), spark.createDataFrame([], "item_id long, text string")) == []
