"""The signature-tree join against brute force."""

import random
import re

import numpy as np
import pytest

from pathgram.llm import ngram_join
from pathgram.llm.components import components
from pathgram.llm.ngram_join import bitmap, keep_one, ngram_components, similar_trees

SCHEMA = "doc_id long, text string, n_shingles string, node string"


def shingle_set(text, width):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not found:
        return frozenset()
    if len(found) < width:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def united(rows, width, percent):
    """Sets of the rows, and the root of each row's class, by comparing everything."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def brute(rows, width, percent):
    """(doc_id, n, component): the smallest id of each class."""
    sets, root = united(rows, width, percent)
    ids = {}
    for r, (doc_id, _) in zip(root, rows):
        if doc_id is not None:
            ids[r] = min(ids.get(r, doc_id), doc_id)
    return sorted(((d, len(s), ids.get(r) if s else d) for (d, _), s, r in zip(rows, sets, root)), key=str)


def classes(rows, width, percent):
    """Rows without words, and classes of the others: an id may name several."""
    sets, root = united(rows, width, percent)
    return sum(not s for s in sets), len({r for s, r in zip(sets, root) if s})


def collected(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def family(rng, words, size, members, edits):
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(members):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(size)] = rng.choice(words)
        yield " ".join(copy)


def make(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "one", "ONE", "one two three", "One two\nthree", "é É", "x" * 5000, "a b c d e f", "a b c d e f g"]
    for size, members, edits in ((30, 12, 2), (60, 25, 3), (120, 40, 5), (400, 10, 20), (20, 30, 1)):
        texts += family(rng, words, size, members, edits)
    line = " ".join(rng.choice(words) for _ in range(12))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) + " " + line for _ in range(60)]
    texts += texts[20:30]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1000))
    return [*rows, (None, texts[3]), (5, texts[40]), (5, texts[40]), (5, texts[41])]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent, monkeypatch):
    rows = make(width)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    assert collected(ngram_components(df, width, percent)) == brute(rows, width, percent)


def test_blocks_in_chunks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = make(9)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(2)
    assert collected(ngram_components(df, 4, 85)) == brute(rows, 4, 85)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert collected(ngram_components(docs, 4, 85)) == brute(rows, 4, 85)


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = make(3)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    kept = keep_one(df)
    assert kept.columns == df.columns
    empty, linked = classes(rows, 5, 80)
    assert kept.count() == empty + linked


def test_unlinked_documents_without_an_own_id_stay(spark):
    words = [[f"{name}{i}" for i in range(40)] for name in "abcdef"]
    texts = [" ".join(w) for w in words]
    near = " ".join([*words[0][:39], "other"])
    rows = [(None, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[5]), (None, texts[5])]
    kept = [(r.doc_id, r.text) for r in keep_one(spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)).collect()]
    assert len(kept) == 6 and len({near, texts[0]} & {t for _, t in kept}) == 1
    assert {(None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[5])} < set(kept)


def test_trees_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = []
    for _ in range(150):
        own = rng.integers(0, 1 << 63, rng.integers(5, 60), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[: rng.integers(10, 300)], own])))
    every = np.arange(len(sets))
    x, y = similar_trees(np.array([len(s) for s in sets]), [bitmap(s) for s in sets], every, every, 80)
    found = set(zip(x.tolist(), y.tolist(), strict=True))
    assert len(found) < len(sets) ** 2 / 2
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert (i, j) in found


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (-5, 3), (-5, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == -5 for i in range(1, 41))
    assert all(found[100 + i] == 100 for i in range(1, 30))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_of_unlike_sizes_never_get_their_bitmaps(spark, monkeypatch):
    """A line that short and long documents share makes one block; only sizes within the percentage are screened."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(words) for _ in range(10))
    texts = [line + " " + " ".join(rng.choice(words) for _ in range(k)) for k in [3, 4, 5, 3, 30, 31, 90, 95, 300, 310, 900, 905, 2700] for _ in range(3)]
    rows = list(enumerate(texts))
    plain, seen = ngram_join.screen, []

    def screen(pairs, maps, percent):
        n = {r.node: r.n for r in maps.collect()}
        seen.extend((n[r.a], n[r.b]) for r in pairs.collect())
        return plain(pairs, maps, percent)

    monkeypatch.setattr(ngram_join, "screen", screen)
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    assert collected(ngram_components(docs, 4, 85)) == brute(rows, 4, 85)
    assert seen and all(100 * min(p) >= 85 * max(p) for p in seen)


def test_prefixes_come_once_a_class(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = ngram_join.prefixes(docs.union(docs), 4, 85, bytes(ngram_join.COUNTERS))
    assert found.columns == ["token", "node", "n"] and found.count() == found.distinct().count()


def test_shingles_frequent_over_all_tasks_come_last(spark, monkeypatch):
    """A line that every task meets a few times only is in no prefix of documents with enough shingles of their own."""
    line = " ".join(f"common{i}" for i in range(8))
    texts = [f"{line} " + " ".join(f"own{d}x{i}" for i in range(60)) for d in range(100)]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in enumerate(texts)], SCHEMA).repartition(25)
    plain, shared = ngram_join.prefixes, []

    def prefixes(*args, **kinds):
        found = plain(*args, **kinds)
        shared.append(found.groupBy("token").count().filter("count > 2").count())
        return found

    monkeypatch.setattr(ngram_join, "prefixes", prefixes)
    assert collected(ngram_components(docs, 4, 85)) == brute(list(enumerate(texts)), 4, 85)
    assert shared == [0]


def test_only_rows_that_reach_another_get_bitmaps(spark, monkeypatch):
    """Documents of one size share lines; most shared shingles come too late in a prefix to be the first that a similar pair shares."""
    rng = random.Random(6)
    lines = [" ".join(f"l{k}w{i}" for i in range(5)) for k in range(12)]
    texts = [" ".join([*rng.sample(lines, 4), *(f"own{d}x{i}" for i in range(rng.randint(60, 90)))]) for d in range(40)]
    texts += [t.rsplit(" ", 1)[0] + " other" for t in texts[:3]]
    rows = list(enumerate(texts))
    monkeypatch.setattr(ngram_join, "levels", lambda *_: bytes(ngram_join.COUNTERS), raising=False)
    plain, seen, blocks = ngram_join.tree_pairs, [], []
    open_plain = ngram_join._open

    def tree_pairs(df, percent):
        seen.append(df.count())
        return plain(df, percent)

    def _open(members, links, percent):
        out = open_plain(members, links, percent)
        blocks.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "tree_pairs", tree_pairs)
    monkeypatch.setattr(ngram_join, "_open", _open)
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    assert collected(ngram_components(docs, 4, 85)) == brute(rows, 4, 85)
    assert seen[-1] < 0.8 * blocks[-1]


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_reach_loses_no_similar_pair(spark, percent):
    rng = random.Random(8)
    base = rng.sample(range(4000), 120)
    sets = []
    for _ in range(80):
        own = set(base[: rng.randint(20, 120)]) | {rng.randrange(4000) for _ in range(rng.randint(0, 25))}
        sets.append(sorted(own))
    firsts = []
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = set(x) & set(y)
            if both and 100 * len(both) >= percent * (len(x) + len(y) - len(both)):
                first = min(both)
                firsts += [(len(x), x.index(first), len(y)), (len(y), y.index(first), len(x))]
    df = spark.createDataFrame(firsts, "n int, at int, other int").withColumn("reach", ngram_join.reach(percent))
    assert firsts and df.filter("other > reach").count() == 0
