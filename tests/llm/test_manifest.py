"""The Merkle manifest against a tree built in a loop."""

import hashlib
import os
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from messy import frame  # noqa: E402

from pathgram.llm.manifest import fold, levels, manifest, siblings  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def fifth(doc_id, text):
    """What the default check finds: the text lower-cased where 5 divides the checksum."""
    hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
    return None if text is None or not hit else text.translate(LOWER)


def brute(rows, changed=fifth):
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    by_source = {}
    for d, t, lang, s, n in rows:
        found = changed(d, t)
        by_source.setdefault(s, []).append((first(d), leaf(d, s, lang, n, t), d, None if found is None else leaf(d, s, lang, n, found)))
    order = sorted(by_source, key=first)
    held = {s: sorted(by_source[s], key=lambda x: x[:2]) for s in order}
    trees = {s: tree([x[1] for x in held[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, own, d, other) in enumerate(held[s]):
            node, proof = other or own, ""
            for nodes, at in ((trees[s], i), (top, k)):
                for level in nodes[:-1]:
                    start = at // 16 * 16
                    left, right = "".join(level[start:at]), "".join(level[at + 1 : start + 16])
                    node, proof, at = sha(left + node + right), proof + left + right, at // 16
            out.append((d, own, trees[s][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def given(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def got(df, **more):
    return sorted((tuple(r) for r in manifest(df, **more).collect()), key=str)


def test_awkward_rows(spark):
    df = frame(spark)
    found = got(df)
    assert found == brute(given(df)) and any(r[-1] for r in found) and not all(r[-1] for r in found)


@pytest.mark.parametrize("n", [1, 16, 17, 4097, 9000])
def test_depths(spark, n):
    """Lone leaves, full and broken runs, one and more superblocks; some sources hold one row."""
    df = spark.range(n).selectExpr(
        "id * 1000000007 - 5 AS doc_id", "concat('Text ', id, repeat('É', id % 3)) AS text", "if(id % 7 = 0, null, 'en') AS lang",
        "CASE WHEN id % 50 = 3 THEN concat('s', id % 20) WHEN id = 11 THEN null WHEN id = 12 THEN '' ELSE 'hot' END AS source", "id AS n_chars")
    assert got(df) == brute(given(df))


def test_many_sources(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "'A' AS text", "'en' AS lang", "concat('host-', id) AS source", "1 AS n_chars")
    assert got(df) == brute(given(df))


def test_any_order_of_rows_and_a_given_change(spark):
    df = spark.range(700).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "concat('s', id % 3) AS source", "2 AS n_chars")
    assert got(df.orderBy(F.rand(1)).repartition(7)) == got(df.coalesce(1))
    changed = F.when(F.col("doc_id") == 77, F.concat("text", F.lit("!")))
    found = got(df, changed_text=changed)
    assert found == brute(given(df), lambda d, t: t + "!" if d == 77 else None) and [r[0] for r in found if not r[-1]] == [77]


def test_empty_table(spark):
    assert got(frame(spark, [])) == []


def test_a_proof_folds_to_the_top():
    nodes = [sha(str(k)) for k in range(300)]
    local, top = levels(nodes, 300)
    assert top == tree(nodes)[-1][0] and all(fold(nodes[k], *siblings(local, k)) == top for k in (0, 15, 16, 255, 299))
