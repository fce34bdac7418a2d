"""Ranked lexical search: a sharded block index of whole texts, and Block-Max MaxScore over its shards.

The index. A shard is a bounded run of documents. Its terms are dealt into pages by a hash of the term; a page is one
row with its terms, and for each term the compressed postings in blocks of 128 (document steps and counts in the fewest
bytes) and the blocks' peaks: for every count in a block the shortest document that has it. Peaks give exact block
maxima whatever the numbers of documents and terms turn out to be, so shards can be added without touching old ones.

The search. Items are dealt into groups; a cell is one shard and one group and holds only the lists that the group asks
for. For an item the highest lists are scored first for a threshold. Lists whose maxima together stay below it are not
essential: their documents count only if an essential list has them too. Block maxima of such lists then reject
candidates before any block is decompressed; only blocks with survivors are opened. A task carries the thresholds from
cell to cell and gives its heaps, which a window merges.

Rules: null texts and texts without a term are in no list and do not count. Equal scores go by ascending id, null last.
Rows are ranked one by one, repeated ids too; every row of the items is an item of its own. Only the named columns are
read. An empty table on either side gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathgram.llm.common import ranked, small
from pathgram.session import materialise

TOP = 20
BLOCK = 128
#: Pages of a shard's dictionary.
PAGES = 32
#: Bytes of text of a shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Items of a group.
GROUP = 512
#: Terms of a page that are counted at a time.
ASKED = 1000
#: Rows of wanted terms up to which they are broadcast; beyond, they are joined in so many salted parts.
BROADCAST_ROWS, SALTS = 256, 64
INDEX = ("shard long, page int, n_docs long, n_terms long, terms binary, lists binary, peaks binary, peak_ends binary, "
         "body binary, body_ends binary")
# ASCII letters in lower case, digits and every byte of longer characters; the rest parts terms.
BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of terms of each text, and the terms of all texts in a row."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # Stripped, since a separator at an end would make an empty term.
    parted = [t.encode().translate(BYTES).strip() for t in texts.to_pylist()]
    found = pc.ascii_split_whitespace(pa.array(parted, pa.large_binary()).cast(pa.large_string()))
    sizes = np.array([len(t) > 0 for t in parted], np.int64) * pc.list_value_length(found).to_numpy(zero_copy_only=False)
    flat = found.flatten()
    return sizes, flat.filter(pc.not_equal(flat, ""))


def page_of(term: bytes) -> int:
    return zlib.crc32(term) % PAGES


def _width(top: np.ndarray) -> np.ndarray:
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Little-endian values of 1, 2 or 4 bytes at the given places."""
    for k in range(4):
        wide = width > k
        if not wide.any():
            return
        out[at[wide] + k] = (values[wide] >> (8 * k)) & 255


def build_shard(shard: int, ids: pa.Array, texts: pa.Array) -> list[tuple]:
    """The rows of one shard: page -1 with its documents, then its dictionary pages."""
    sizes, flat = term_lists(texts)
    n = len(sizes)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    keys = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8")
    docs = (shard, -1, int((sizes > 0).sum()), int(sizes.sum()), b"", b"", keys.tobytes(), known.astype("u1").tobytes(), sizes.astype("<u4").tobytes(), b"")
    if not len(flat):
        return [docs]
    coded = flat.dictionary_encode()
    terms = [t.encode() for t in coded.dictionary.to_pylist()]
    page = np.array([page_of(t) for t in terms])
    order = np.argsort(page, kind="stable")
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    key = np.sort(rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), sizes))
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(starts, append=len(key))
    term, doc = np.divmod(key[starts], n)
    del key, flat, coded, rank
    # Postings of a term, cut into blocks.
    first = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(first, append=len(term))
    place = np.arange(len(term)) - np.repeat(first, df)
    opens = np.flatnonzero(place % BLOCK == 0)
    in_block = np.diff(opens, append=len(term))
    block = np.repeat(np.arange(len(opens)), in_block)
    step = np.diff(doc, prepend=0)
    step[opens] = 0
    wide_step, wide_tf = _width(np.maximum.reduceat(step, opens)), _width(np.maximum.reduceat(tf, opens))
    bytes_of = in_block * (wide_step + wide_tf)
    at = np.concatenate([[0], np.cumsum(bytes_of)])
    body = np.zeros(at[-1], np.uint8)
    inner = np.arange(len(term)) - opens[block]
    _put(body, at[block] + inner * wide_step[block], step, wide_step[block])
    _put(body, at[block] + (in_block * wide_step)[block] + inner * wide_tf[block], tf, wide_tf[block])
    # Peaks: of each block and count the shortest document.
    by_size = np.argsort(sizes, kind="stable")
    size_rank = np.empty(n, np.int64)
    size_rank[by_size] = np.arange(n)
    counts, tf_rank = np.unique(tf, return_inverse=True)
    peak = np.sort((block * len(counts) + tf_rank) * n + size_rank[doc])
    group, size_at = np.divmod(peak, n)
    leads = np.flatnonzero(np.diff(group, prepend=-1))
    of_block, of_tf = np.divmod(group[leads], len(counts))
    peaks = np.stack([doc[opens][of_block], in_block[of_block], (wide_step * 8 + wide_tf)[of_block], counts[of_tf],
                      sizes[by_size][size_at[leads]]], axis=1).astype("<u4")
    term_of_peak = term[opens][of_block]
    rows = [docs]
    pages = page[order]
    for p in np.unique(pages):
        lo, hi = np.searchsorted(pages, [p, p + 1])
        a, b = np.searchsorted(term_of_peak, [lo, hi])
        ends = np.searchsorted(term_of_peak, np.arange(lo + 1, hi + 1)) - a
        blocks = np.searchsorted(term[opens], np.arange(lo, hi + 1))
        cuts = at[blocks]
        rows.append((shard, int(p), 0, 0, b" ".join([terms[k] for k in order[lo:hi]]), df[lo:hi].astype("<u4").tobytes(), peaks[a:b].tobytes(),
                     ends.astype("<u4").tobytes(), body[cuts[0] : cuts[-1]].tobytes(), (cuts[1:] - cuts[0]).astype("<u4").tobytes()))
    return rows


def _index_batches(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    shard = (context.partitionId() if context else 0) << 24
    held, weight = [], 0

    def flush():
        nonlocal held, weight, shard
        ids = pa.concat_arrays([a.cast(pa.int64()) for a, _ in held])
        texts = pa.concat_arrays([t.cast(pa.large_string()) for _, t in held])
        rows = build_shard(shard, ids, texts)
        shard, held, weight = shard + 1, [], 0
        pa.default_memory_pool().release_unused()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SHARD_TYPES)], names=SHARD_NAMES)

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start = 0
        for k, size in enumerate(sizes):
            if weight and weight + size > shard_bytes:
                if k > start:
                    held.append((ids.slice(start, k - start), texts.slice(start, k - start)))
                yield flush()
                start = k
            weight += int(size) + 1
        if len(ids) > start:
            held.append((ids.slice(start), texts.slice(start)))
    if held:
        yield flush()


SHARD_NAMES = [c.split()[0] for c in INDEX.split(", ")]
SHARD_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in INDEX.split(", ")]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of every row as a written table; shards come from the scan's partitions, without a shuffle."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return materialise(rows.mapInArrow(lambda batches: _index_batches(batches, shard_bytes), INDEX), "lexical-index")


# --- search


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times): the terms of the items, by the index's own rule."""

    def cut(batches):
        for batch in batches:
            sizes, flat = term_lists(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), flat.cast(pa.string())], names=["item", "term"])

    return items.mapInArrow(cut, "item long, term string").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def _wanted(index: DataFrame, per_page: DataFrame, columns: list[str]) -> DataFrame:
    """Pages of the index with what is wanted of them, for every row of ``per_page``.

    Few rows (each of some thousand terms at most) are broadcast. More are joined by page and a salt of the shard, so
    that a page of the dictionary is spread over many tasks.
    """
    pages = index.filter("page >= 0").select(*columns, "shard").withColumnRenamed("page", "of_page")
    if per_page.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return pages.join(F.broadcast(per_page), F.col("of_page") == F.col("page")).drop("of_page")
    salted = per_page.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    pages = pages.withColumn("of_salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)))
    return pages.join(salted, (F.col("of_page") == F.col("page")) & (F.col("of_salt") == F.col("salt"))).drop("of_page", "of_salt", "salt")


def document_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): documents that hold a term, over all shards. Only dictionaries are read."""
    paged = terms.select("term", (F.crc32(F.col("term").cast("binary")) % PAGES).cast("int").alias("page")).distinct()
    parts = paged.count() // (PAGES * ASKED) + 1
    asked = paged.groupBy("page", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("slice")).agg(F.collect_list("term").alias("asked"))
    asked = materialise(asked.drop("slice"), "lexical-asked")

    def count(batches):
        for batch in batches:
            out: dict[str, int] = {}
            for held, lists, asked_for in zip(*(batch.column(k).to_pylist() for k in range(3))):
                place = {t: k for k, t in enumerate(held.split(b" "))}
                df = _numbers(lists)
                for t in asked_for:
                    if (k := place.get(t.encode())) is not None:
                        out[t] = out.get(t, 0) + int(df[k])
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["term", "n"])

    found = _wanted(index, asked, ["page", "terms", "lists"]).select("terms", "lists", "asked")
    return found.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Postings:
    """One term's list in one shard: block bounds at once, postings only of blocks that are asked for."""

    def __init__(self, peaks: bytes, body: bytes, scale: np.ndarray, rate):
        table = np.frombuffer(peaks, "<u4").reshape(-1, 5).astype(np.int64)
        opens = np.flatnonzero(np.diff(table[:, 0], prepend=-1))
        self.first, self.size, code = table[opens, 0], table[opens, 1], table[opens, 2]
        self.wide = np.stack([code // 8, code % 8], axis=1)
        self.top = np.maximum.reduceat(rate(table[:, 3], table[:, 4]), opens)
        self.at = np.concatenate([[0], np.cumsum(self.size * self.wide.sum(axis=1))])
        self.body, self.scale = body, scale
        self.best = int(self.top.max())
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.all: tuple[np.ndarray, np.ndarray] | None = None

    def open(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what the term gives them, before its weight."""
        if b not in self.opened:
            n, (ws, wt), at = int(self.size[b]), self.wide[b], int(self.at[b])
            step = np.frombuffer(self.body, f"<u{ws}", n, at).astype(np.int64)
            tf = np.frombuffer(self.body, f"<u{wt}", n, at + n * int(ws)).astype(np.int64)
            doc = self.first[b] + np.cumsum(step)
            self.opened[b] = doc, 1_000_000_000 * tf // (1000 * tf + 12 * self.scale[doc])
        return self.opened[b]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            found = [self.open(b) for b in range(len(self.first))]
            self.all = np.concatenate([d for d, _ in found]), np.concatenate([v for _, v in found])
        return self.all

    def bound(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that could hold each document, and its maximum; block -1 and 0 before the first."""
        b = np.searchsorted(self.first, docs, side="right") - 1
        return b, np.where(b >= 0, self.top[b], 0)

    def values(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """What the term gives each of some ascending documents; opens their blocks only."""
        out = np.zeros(len(docs), np.int64)
        here = np.unique(blocks)
        for b in here[here >= 0]:
            lo, hi = np.searchsorted(blocks, [b, b + 1])
            held, value = self.open(b)
            k = np.minimum(np.searchsorted(held, docs[lo:hi]), len(held) - 1)
            out[lo:hi] = np.where(held[k] == docs[lo:hi], value[k], 0)
        return out


def _complete(docs: np.ndarray, score: np.ndarray, lists: list[tuple[int, Postings]], floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Adds lists, highest first, to the scores of ascending candidates; drops those that cannot reach ``floor``."""
    if not lists or not len(docs):
        return docs, score
    lists = sorted(lists, key=lambda x: -x[0] * x[1].best)
    rest = np.cumsum([w * p.best for w, p in lists][::-1])[::-1]
    live = score + rest[0] >= floor
    docs, score = docs[live], score[live]
    where, tops = zip(*((b, w * t) for (w, p) in lists for b, t in [p.bound(docs)]))
    # Block maxima of all the lists together reject before any block is opened.
    left = np.sum(tops, axis=0)
    live = np.flatnonzero(score + left >= floor)
    for k, (w, p) in enumerate(lists):
        if not len(live):
            break
        score[live] += w * p.values(docs[live], where[k][live])
        left = left - tops[k]
        live = live[score[live] + left[live] >= floor]
    return docs[live], score[live]


class Heap:
    """The best documents of one item so far, best first; equal scores by id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """Least score that can still enter."""
        return max(1, self.rows[-1][0]) if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if len(scores) > self.k:  # no more than k at the edge count, by id
            order = np.lexsort((ids, ~known, -scores))[: self.k]
            scores, ids, known = scores[order], ids[order], known[order]
        rows = [(int(s), bool(k), int(d)) for s, d, k in zip(scores, ids, known) if s > 0]
        self.rows = sorted([*self.rows, *rows], key=lambda r: (-r[0], not r[1], r[2]))[: self.k]


def search_shard(heap: Heap, lists: list[tuple[int, Postings]], ids: np.ndarray, known: np.ndarray) -> None:
    """Block-Max MaxScore of one item over one shard."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].best)
    if not lists:
        return
    floor = heap.floor
    if floor == 1:  # a first threshold: the documents of the highest lists, in full
        docs = np.zeros(0, np.int64)
        for _, p in reversed(lists):
            docs = np.union1d(docs, p.whole()[0])
            if len(docs) >= heap.k:
                break
        _, score = _complete(docs, np.zeros(len(docs), np.int64), lists, 0)
        if len(score) >= heap.k:
            floor = max(1, int(np.partition(score, -heap.k)[-heap.k]))
    reach = np.cumsum([w * p.best for w, p in lists])
    cut = int(np.searchsorted(reach, floor))  # lists before it stay below the threshold together
    total = np.zeros(len(ids), np.int64)
    for w, p in lists[cut:]:
        docs, value = p.whole()
        total[docs] += w * value
    docs = np.flatnonzero(total)
    docs, score = _complete(docs, total[docs], lists[:cut], floor)
    good = score >= floor
    heap.add(score[good], ids[docs[good]], known[docs[good]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after another, so that only one page is held besides the batch."""
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            yield {n: batch.column(c)[k].as_py() for c, n in enumerate(names)}


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (group, shard) after another."""
    held, key = [], None
    for row in _rows(batches):
        if (row["group"], row["shard"]) != key:
            if held:
                yield held
            held, key = [], (row["group"], row["shard"])
        held.append(row)
    if held:
        yield held


def _search_cells(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    def rate(tf, size):
        return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * size * n_docs // n_terms))

    def out(heaps):
        rows = [(item, s, d if known else None) for item, h in heaps.items() for s, known, d in h.rows]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "score", "doc_id"])

    heaps: dict[int, Heap] = {}
    group = None
    for cell in _cells(batches):
        if cell[0]["group"] != group:
            if heaps:
                yield out(heaps)
            heaps, group = {}, cell[0]["group"]
        if cell[0]["page"] != -1:
            raise ValueError("a shard without its documents")
        ids, known = np.frombuffer(cell[0]["peaks"], "<i8"), np.frombuffer(cell[0]["peak_ends"], "u1") > 0
        scale = 75 + 25 * _numbers(cell[0]["body"]) * n_docs // n_terms
        asked: dict[int, list] = {}
        for row in cell[1:]:
            place = {t: k for k, t in enumerate(row["terms"].split(b" "))}
            peak_ends, body_ends = _numbers(row["peak_ends"]), _numbers(row["body_ends"])
            for term, users in zip(row["asked"], row["users"]):
                j = place.get(term.encode())
                if j is None:
                    continue
                a, c = (int(peak_ends[j - 1]), int(body_ends[j - 1])) if j else (0, 0)
                p = Postings(row["peaks"][20 * a : 20 * int(peak_ends[j])], row["body"][c : int(body_ends[j])], scale, rate)
                for item, weight in users:
                    asked.setdefault(item, []).append((weight, p))
        for item, lists in asked.items():
            search_shard(heaps.setdefault(item, Heap(k)), lists, ids, known)
    if heaps:
        yield out(heaps)


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a page only the lists that the group asks for."""
    for row in _rows(batches):
        terms = row["terms"].split(b" ")
        place = {t: k for k, t in enumerate(terms)}
        hit = sorted((place[u["term"].encode()], n) for n, u in enumerate(row["uses"]) if u["term"].encode() in place)
        if not hit:
            continue
        peak_ends, body_ends = _numbers(row["peak_ends"]), _numbers(row["body_ends"])
        peaks = [row["peaks"][20 * (int(peak_ends[j - 1]) if j else 0) : 20 * int(peak_ends[j])] for j, _ in hit]
        bodies = [row["body"][(int(body_ends[j - 1]) if j else 0) : int(body_ends[j])] for j, _ in hit]
        uses = [row["uses"][n] for _, n in hit]
        yield pa.RecordBatch.from_pylist([{
            "group": row["group"], "shard": row["shard"], "page": row["page"], "terms": b" ".join(terms[j] for j, _ in hit),
            "peaks": b"".join(peaks), "peak_ends": np.cumsum([len(p) // 20 for p in peaks]).astype("<u4").tobytes(),
            "body": b"".join(bodies), "body_ends": np.cumsum([len(b) for b in bodies]).astype("<u4").tobytes(),
            "asked": [u["term"] for u in uses], "users": [[[v["item"], v["weight"]] for v in u["users"]] for u in uses],
        }], schema=CELL_TYPES)


CELL = ("group long, shard long, page int, terms binary, peaks binary, peak_ends binary, body binary, body_ends binary, "
        "asked array<string>, users array<array<array<long>>>")
CELL_TYPES = pa.schema([("group", pa.int64()), ("shard", pa.int64()), ("page", pa.int32()), *((c, pa.binary()) for c in ("terms", "peaks", "peak_ends", "body", "body_ends")),
                        ("asked", pa.list_(pa.string())), ("users", pa.list_(pa.list_(pa.list_(pa.int64()))))])


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP, group: int = GROUP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, best first."""
    spark = index.sparkSession
    total = index.filter("page = -1").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(total[0] or 0), int(total[1] or 0)
    empty = spark.createDataFrame([], f"{key} long, rank int, doc_id long, score long")
    named = ranked(items.select(F.col(key).alias("name"), F.col(text).alias("words")), [F.col("name"), F.xxhash64("words")], "item", "lexical-items")
    named = materialise(named, "lexical-named")
    if not n_terms or named.isEmpty():
        return empty
    terms = materialise(item_terms(named.select("item", "words")), "lexical-terms")
    df = materialise(document_counts(index, terms), "lexical-counts")
    # Few rows: one for each term that an item has and a document holds.
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    used = terms.join(df, "term").withColumn("weight", weight * F.col("times")).filter("weight > 0")
    per_term = used.groupBy(F.expr(f"item div {group}").alias("group"), "term").agg(
        F.collect_list(F.struct("item", "weight")).alias("users"))  # at most the items of a group
    uses = per_term.withColumn("page", (F.crc32(F.col("term").cast("binary")) % PAGES).cast("int"))
    uses = materialise(uses.groupBy("group", "page").agg(F.collect_list(F.struct("term", "users")).alias("uses")), "lexical-uses")
    lists = _wanted(index, uses, ["page", "terms", "peaks", "peak_ends", "body", "body_ends"])
    lists = lists.select("group", "shard", "page", "terms", "peaks", "peak_ends", "body", "body_ends", "uses").mapInArrow(_picked, CELL)
    groups = int(named.agg(F.max("item")).first()[0]) // group
    heads = index.filter("page = -1").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups).cast("long"))).alias("group"), "shard", "page", "terms", "peaks", "peak_ends", "body", "body_ends",
        F.array().cast("array<string>").alias("asked"), F.array().cast("array<array<array<long>>>").alias("users"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = lists.unionByName(heads).repartition(parts, "group", "shard").sortWithinPartitions("group", "shard", "page")
    found = cells.mapInArrow(lambda batches: _search_cells(batches, n_docs, n_terms, k), "item long, score long, doc_id long")
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = named.select(F.col("item").alias("of"), "name")
    return best.join(names, F.col("item") == F.col("of")).select(F.col("name").alias(key), "rank", "doc_id", "score")


