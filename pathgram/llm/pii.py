"""Personal data by fixed patterns, and by contexts bootstrapped from what those find.

Fixed patterns mark e-mail and IP addresses, card and phone numbers (``find_base``). They are the
seeds. The word in front of a seed is a context; a context is scored, per kind, by how often an
identifier of that kind follows it among all its occurrences in the corpus. Other strings that could
be of a kind by their loose form (an address without a domain, a number without its plus sign) get
the combined score of the contexts that they stand in anywhere, and in turn add to the scores of those
contexts. After some rounds, contexts with a high score and enough different seeds mark the candidates
behind them.

Positions are code points, ends exclusive. A null text counts as empty. Rows that repeat are searched
each on their own. Very long runs of digits or letters take linear time. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathgram.llm.common import small, whole
from pathgram.session import materialise

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A context marks candidates from this score and this many different seeds on.
CONFIDENCE = 0.6
SUPPORT = 5
#: Size of the table of hashed contexts that tells tasks which words to count (fixed, whatever the number of contexts).
SLOTS = 1 << 20
#: Distinct words that a task counts before it passes them on.
COUNT_WORDS = 300_000
#: Longer words are no contexts.
WORD_CHARS = 40

# Each pattern reads a text once: runs are taken whole, and a run is entered only at its start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOOSE_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,3}[0-9])++")
_LOOSE_ADDRESS = re.compile(r"(?<!\S)[^\s@]+@[^\s@]+(?!\S)")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield 0, start, found.end()
        # The characters up to this sign are in no later address: it stands between.
        free = found.end() if found else at + 1
        at = text.find("@", free)


def find_base(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind. Leftmost and non-overlapping for each kind."""
    out = list(_emails(text)) if "@" in text else []
    if any(c in text for c in "0123456789"):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for kind, pattern, low, high in ((2, _CARD, 14, 19), (3, _PHONE, 10, 15)):
            for m in pattern.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                    out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def find_loose(text: str, base: list[Span]) -> list[Span]:
    """Strings that may be of a kind by their form, outside the base spans."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _LOOSE_ADDRESS.finditer(text)]
    for m in _LOOSE_NUMBER.finditer(text) if any(c in text for c in "0123456789") else ():
        n = sum(c.isdigit() for c in m[0])
        kind = 1 if m[0].count(".") == 3 and n <= 12 else 2 if 13 <= n <= 19 else 3 if 7 <= n <= 12 else None
        if kind:
            out.append((kind, m.start(), m.end()))
    free, at = [], 0
    for kind, a, b in sorted(out, key=lambda s: s[1]):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            free.append((kind, a, b))
    return free


def context(text: str, start: int) -> str:
    """The word before a place, in lower case; one opening sign may stand between. Empty if there is none."""
    left = text[max(0, start - 2 * WORD_CHARS) : start]
    if left and not left[-1].isspace():
        left = left[:-1]
    if not left or not left[-1].isspace():
        return ""
    found = left.split()
    cut = len(found) == 1 and not left[0].isspace() and start > 2 * WORD_CHARS
    return found[-1].lower() if found and not cut and len(found[-1]) <= WORD_CHARS else ""


_SPANS = "array<struct<kind:int,start:int,end:int,value:string,context:string,seed:boolean>>"
_STRUCT = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("context", pa.string()), ("seed", pa.bool_())]))
_SCHEMA = f"doc_id long, spans {_SPANS}"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their spans."""
    for batch in batches:
        found = []
        for text in batch["text"]:
            text = text.as_py()
            base = find_base(text)
            rows = []
            for kind, a, b, seed in [(*s, True) for s in base] + [(*s, False) for s in find_loose(text, base)]:
                rows.append({"kind": kind, "start": a, "end": b, "value": text[a:b].lower()[:200], "context": context(text, a), "seed": seed})
            found.append(rows)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, _STRUCT)], names=["doc_id", "spans"])


def count_words(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(word, times) of the words in ``contexts`` over all texts.

    Tasks know the contexts by a table of ``SLOTS`` hash slots; words that only share a slot go in the last join.
    """
    slots = contexts.select((F.crc32("word") % SLOTS).cast("int").alias("slot")).distinct().collect()  # SLOTS rows at most
    wanted = bytearray(SLOTS)
    for row in slots:
        wanted[row.slot] = 1
    wanted = bytes(wanted)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        ready: Counter[str] = Counter()

        def settle() -> None:
            for word, n in counts.items():
                if wanted[zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS]:
                    ready[word] += n
            counts.clear()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(ready), pa.string()), pa.array(list(ready.values()), pa.int64())], names=["word", "times"])
            ready.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                counts.update(text.as_py().lower().split())
                if len(counts) > COUNT_WORDS:
                    settle()
            if len(ready) > COUNT_WORDS:
                yield rows()
        settle()
        yield rows()

    found = texts.mapInArrow(task, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))
    return found.join(contexts, "word", "left_semi")


def score_contexts(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Contexts (context, kind, score, support) from edges (context, kind, value, n, seed).

    A context's score is the summed belief in what follows it over its occurrences ``total``; a
    candidate's belief is what its contexts leave no doubt about together. Seeds are believed fully.
    """
    beliefs = materialise(edges.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("belief")), "pii-beliefs")
    contexts = None
    for _ in range(rounds):
        weighed = edges.join(beliefs, ["kind", "value"])
        contexts = weighed.groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("mass"), F.sum("belief").alias("support"))
        contexts = contexts.join(totals, F.col("context") == F.col("word")).select("context", "kind", F.least(F.lit(1.0), F.col("mass") / F.col("times")).alias("score"), "support")
        contexts = materialise(contexts, "pii-contexts")
        doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))
        again = edges.filter("NOT seed").join(contexts.filter(F.col("support") >= SUPPORT), ["context", "kind"]).groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("found"))
        beliefs = beliefs.join(again, ["kind", "value"], "left").select("kind", "value", F.greatest("belief", F.coalesce("found", F.lit(0.0))).alias("belief"))
        beliefs = materialise(beliefs, "pii-beliefs")
    return contexts


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and added (arrays of kind, start, end; kinds are places in ``KINDS``)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    rows = materialise(texts.mapInArrow(_search, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "pii-searched")
    found = rows.filter(F.size("spans") > 0).select("row", F.explode_outer("spans").alias("s")).select("row", "s.*").filter("context <> ''")
    edges = found.groupBy("context", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    # Contexts with fewer different values can never get the support they need. Others can, also without a seed of their own.
    enough = edges.groupBy("context", "kind").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") >= SUPPORT)
    edges = materialise(edges.join(enough.select("context", "kind"), ["context", "kind"], "left_semi"), "pii-edges")
    contexts = materialise(edges.select(F.col("context").alias("word")).distinct(), "pii-words")
    totals = materialise(count_words(texts.select("text"), contexts), "pii-totals")
    sure = score_contexts(edges, totals).filter((F.col("score") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("context", "kind")
    added = found.filter("NOT seed").join(small(materialise(sure, "pii-sure")), ["context", "kind"], "left_semi")
    added = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    base = F.transform(F.filter("spans", lambda s: s["seed"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    rows = rows.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    return rows.select("doc_id", "base", F.coalesce("added", none).alias("added"))


def spelled(spans) -> object:
    """Spans as kind:start:end, by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
