"""A small table with every awkward case, and helpers of the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars int, "
    "size long, n_words string, key string, row long, full string, code int, len int, rows string, bits int, start double, kept string, word string"
)
EXTRA = (7, "a", "b", 1, "c", 2, 3, "d", 4, 0.5, "e", "f")


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta,", "Gamma.", "été", "Straße", "naïve", "don't", "x", "42", "3.14", "#tag", "$5", "<b>", "a|b", "日本語", "İstanbul", "ΟΔΟΣ", "ö", " nbsp", "z​w", "a\x1cb"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    passage = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(6))
    out = [None, "", " ", "\n\t\r\x0b\x0c ", "one", "one  two\tthree", "one two three", " one two three", "a b c d e " * 30, "Hi.\nHi.\nHi.\nHi.", "a\nb\n\na\n b"]
    out += ["\n".join(rng.sample(lines, rng.randrange(1, 12))) for _ in range(25)]
    out += [f"intro {i} {rng.choice(words)}\n{passage}\n{rng.choice(lines)}" for i in range(8)]
    out += [" ".join(rng.choice(words) for _ in range(9000)), "y" * 20000, out[20], out[20].replace(" ", "\n", 3), out[21]]
    return out


def messy_rows():
    """(doc_id, text, source) with null ids, null sources, repeated rows and ids that repeat."""
    found = [(100 + i, t, ["s1", "s2", None, "S0", "é"][i % 5]) for i, t in enumerate(texts())]
    return [*found, found[12], found[12], (None, "no id here " * 20, "s1"), (None, None, None), (112, "other text, same id " * 5, "s2")]


def frame(spark, rows=None, parts=3):
    """The rows as documents, with extra columns named like the operators' own."""
    rows = messy_rows() if rows is None else rows
    data = [(d, t, "en", s, None if t is None else len(t), *EXTRA) for d, t, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts) if data else spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
