"""Registered queries of the corpus operators, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathgram.llm.common import load
from pathgram.llm.exact_dedup import exact_duplicates
from pathgram.llm.lexical import build_index, search
from pathgram.llm.licences import scan_licences
from pathgram.llm.line_dedup import remove_repeated_lines
from pathgram.llm.manifest import manifest
from pathgram.llm.mixing import fair_queue
from pathgram.llm.ngram_join import ngram_components
from pathgram.llm.packing import pack_documents
from pathgram.llm.pii import KINDS, find_personal_data, spelled
from pathgram.llm.pivot_index import top_products
from pathgram.llm.rules import judge
from pathgram.llm.site_quality import site_quality
from pathgram.llm.token_files import token_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
END_ID = 2


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(load(spark, sf_dir, "documents"), vocabulary(), END_ID)


OP2_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i+2])) AS gram FROM w WHERE len(ws) > 2),
m AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
p AS (SELECT r, count(DISTINCT k)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM m) GROUP BY r),
f AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(ls)::BIGINT AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS broken,
             100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words AS strict
      FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR broken)::DOUBLE AS k FROM b GROUP BY source),
s AS (SELECT sum(n) AS total, sum(k) AS failed, sum(k) / sum(n) AS mean, sum(n * n) AS squares, sum(k * k / n) AS scatter, count(*) AS hosts FROM h),
v AS (SELECT *, total - squares / total - (hosts - 1) AS free, mean * (1 - mean) AS noise FROM s),
a AS (SELECT mean, 1 / least(greatest(CASE WHEN noise > 0 AND free > 0 THEN ((scatter - mean * failed) / noise - (hosts - 1)) / free ELSE 0 END, 1e-4), 0.5) - 1 AS weight FROM v),
z AS (SELECT h.*, (k + greatest(mean, 1e-6) * weight) / (n + (greatest(mean, 1e-6) + greatest(1 - mean, 1e-6)) * weight) AS rate FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT CASE WHEN rate >= 0.5 THEN strict ELSE broken END AS kept,
       n::BIGINT AS host_docs, k::BIGINT AS host_failed, round(rate, 6) AS host_rate
FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source
"""


@query("op2_host_rules", OP2_SQL)
def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(load(spark, sf_dir, "documents"), "doc_id").drop("n_lines")
    return rows.withColumn("host_rate", F.round("host_rate", 6))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS code, length(line) >= 150 AS long FROM l),
c AS (SELECT *, long OR coalesce(lead(long) OVER w, true) OR coalesce((code + 31 * lag(code) OVER w) % 2 = 0, false) AS ends
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM c),
k AS (SELECT doc_id, chunk, min(i) AS first, max(i) AS last, string_agg(line, chr(10) ORDER BY i) AS body FROM n GROUP BY doc_id, chunk),
e AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) > 1 AS again FROM k
      WHERE length(body) >= 40 AND (last > first OR length(body) >= 150)),
x AS (SELECT n.*, coalesce(again, false) AS gone FROM n LEFT JOIN e USING (doc_id, chunk))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM x GROUP BY doc_id
"""


@query("op3_line_chunk_dedup", OP3_SQL)
def op3_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return rows.select("doc_id", "n_lines", "n_removed", "text")


def base_count(kind: int) -> Column:
    """Base spans of a kind. The function takes one argument only: Spark would pass the place in the array as a second."""
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


@query("op4_context_pii")
def op4_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(load(spark, sf_dir, "documents"))
    counts = [base_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base, every = spelled(F.col("base")), spelled(F.concat("base", "added"))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


@query("op5_signature_tree_join")
def op5_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_components(load(spark, sf_dir, "documents"), width=4, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id")


@query("op6_licence_paragraphs")
def op6_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(load(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER p, 0)::DOUBLE AS cap_before, sum(weight) OVER a AS weight_left FROM c
      WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             a AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, cap < weight * ((budget - cap_before) / weight_left) AS above FROM o),
l AS (SELECT max(budget) - coalesce(sum(cap) FILTER (above), 0) AS rest, sum(weight) FILTER (NOT above) AS weights FROM f),
t AS (SELECT f.source, f.source_size, CASE WHEN above THEN cap ELSE l.rest * weight / l.weights END AS target FROM f, l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS lim,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size) - d.size)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, lim - before)) + greatest(0, least(size, lim - before - source_size)))::BIGINT AS taken
FROM q
"""


@query("op7_fair_queue_mix", OP7_SQL)
def op7_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_queue(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), vocabulary(), END_ID)


@query("op9_site_quality")
def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS flat FROM documents),
h AS (SELECT doc_id, sha256(flat) AS text_sha256, min(doc_id) OVER (PARTITION BY flat) AS keep_id,
             count(*) OVER (PARTITION BY flat)::BIGINT AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h
"""


@query("op10_progressive_exact_dedup", OP10_SQL)
def op10_progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"), digest=True)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
v AS MATERIALIZED (SELECT r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM d),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


@query("op11_pivot_distance_search", OP11_SQL)
def op11_pivot_distance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(load(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
n AS MATERIALIZED (SELECT r, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
p AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY term, docs),
i AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT i, item_id, p.r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN p USING (term) JOIN n ON n.r = p.r, c GROUP BY i, item_id, p.r, doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM t WHERE rank <= 20
"""


@query("op12_block_max_search", OP12_SQL)
def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(load(spark, sf_dir, "documents")), load(spark, sf_dir, "benchmark"))


def _manifest_sql(inside: int = 6, over: int = 4) -> str:
    """The manifest level by level, for up to 16 ** inside rows a source and 16 ** over sources."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    head = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = field.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    checksum = ("xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), "
                "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)")
    parts = [
        f"d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, sha256({head} || {field.format('text')}) AS leaf, "
        f"CASE WHEN {checksum} % 5 = 0 THEN sha256({head} || {lowered}) END AS changed FROM documents)",
        "o AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d))",
        "e AS MATERIALIZED (SELECT d.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, "
        "count(*) OVER (PARTITION BY tree) AS total FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source)",
        "a0 AS (SELECT tree, idx, leaf AS node, total FROM e)",
    ]

    def tree(name: str, depth: int) -> None:
        for k in range(depth):
            parts.append(f"{name}s{k} AS MATERIALIZED (SELECT x.tree, x.idx, x.total, coalesce(string_agg(y.node, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS l, "
                         f"coalesce(string_agg(y.node, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS r FROM {name}{k} x JOIN {name}{k} y "
                         "ON x.tree = y.tree AND x.idx // 16 = y.idx // 16 GROUP BY x.tree, x.idx, x.total)")
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, idx // 16 AS idx, CASE WHEN total = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY idx)) END AS node, "
                         f"(total + 15) // 16 AS total FROM {name}{k} GROUP BY tree, idx // 16, total)")

    tree("a", inside)
    parts.append(f"b0 AS (SELECT 0 AS tree, tree AS idx, node, count(*) OVER () AS total FROM a{inside})")
    tree("b", over)
    parts.append(f"f0 AS (SELECT row, doc_id, leaf, tree, idx, coalesce(changed, leaf) AS h, '' AS p FROM e)")
    steps = [("a", k, "f.tree", f"f.idx // {16 ** k}") for k in range(inside)] + [("b", k, "0", f"f.tree // {16 ** k}") for k in range(over)]
    for n, (name, k, of, at) in enumerate(steps):
        parts.append(f"f{n + 1} AS MATERIALIZED (SELECT f.row, f.doc_id, f.leaf, f.tree, f.idx, CASE WHEN s.total = 1 THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h, "
                     f"f.p || s.l || s.r AS p FROM f{n} f JOIN {name}s{k} s ON s.tree = {of} AND s.idx = {at})")
    return (f"WITH {', '.join(parts)} SELECT f.doc_id, f.leaf, b0.node AS subroot, t.node AS root, sha256(f.p) AS proof_sha256, f.h AS folded_root, "
            f"f.h = t.node AS verified FROM f{len(steps)} f JOIN b0 ON b0.idx = f.tree, b{over} t")


OP13_SQL = _manifest_sql()


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(load(spark, sf_dir, "documents"))
