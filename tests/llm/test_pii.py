"""Fixed patterns against plain regular expressions, and discovery through contexts."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pathgram.llm import queries
from pathgram.llm.pii import KINDS, find_base, find_personal_data, luhn, spelled

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, name in enumerate(KINDS):
        for m in re.finditer(PLAIN[name], text):
            n = len(re.sub("[^0-9]", "", m[0]))
            good = {
                "email": True,
                "ip": name == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= n <= 19 and luhn(re.sub("[^0-9]", "", m[0])),
                "phone": 10 <= n <= 15,
            }[name]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@+-%1 25()é\n0", max_size=40))
def test_base_equals_plain_patterns(text):
    assert find_base(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "@a" * 100_000, "1 " * 200_000):
        find_base(text)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = find_personal_data(docs).select("doc_id", spelled("base").alias("spans")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.spans == ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in plain(texts[r.doc_id] or ""))
    assert any(r.spans for r in rows)


def test_contexts_find_unseen_identifiers(spark):
    seeds = [f"please write mailto: user{i}@mail{i}.example.com now, or hotline: +1 (505) 555-{1000 + i} at once" for i in range(12)]
    texts = [*seeds, "write mailto: boss@intranet today", "the hotline: (505) 555-9876 is open", "count 505 555 9876 sheep", "meet me@home then", None, ""]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3)
    rows = {r.doc_id: r for r in find_personal_data(df).select("doc_id", spelled("base").alias("base"), spelled("added").alias("added")).collect()}
    assert len(rows) == len(texts)
    assert rows[12].added == "email:14:27" and not rows[12].base
    assert rows[13].added == "phone:14:27"
    assert not rows[14].added and not rows[15].added and not rows[16].base and not rows[17].base


def test_contexts_without_seeds_are_learned_through_candidates(spark):
    seeds = [f"hotline: +1 (505) 555-{1000 + i} now" for i in range(30)]
    both = [f"hotline: (505) 555-{2000 + i} or ring (505) 555-{2000 + i} today" for i in range(10)]
    texts = [*seeds, *both, "please ring (505) 555-9999 soon", "please count (505) 555-9998 sheep"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r.added for r in find_personal_data(df).select("doc_id", spelled("added").alias("added")).collect()}
    assert rows[40] == "phone:13:26" and not rows[41]
    assert all(len(rows[30 + i].split(",")) == 2 for i in range(10))


def test_empty_and_repeated(spark):
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "x 1.2.3.4")], "doc_id long, text string")
    rows = sorted((str(r.doc_id), r.s) for r in find_personal_data(df).select("doc_id", spelled("base").alias("s")).collect())
    assert rows == [("1", "email:0:6"), ("1", "email:0:6"), ("None", "ip:2:9")]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_query_counts_every_base_span_by_kind(spark, tmp_path):
    """Also with several kinds in a text, in any order."""
    texts = ["a@b.cd", "1.2.3.4 then a@b.cd and c@d.ef", "+1 (505) 555-1000 or 4111 1111 1111 1111", "x 4111111111111111, 10.0.0.1, me@home.org, +44 20 7946 0958", None, "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.QUERIES["op4_context_pii"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        spans = plain(text or "")
        assert [rows[k][f"n_{name}"] for name in KINDS] == [sum(s[0] == kind for s in spans) for kind in range(len(KINDS))]
        assert rows[k].base_sha256 == hashlib.sha256(",".join(f"{KINDS[a]}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()
