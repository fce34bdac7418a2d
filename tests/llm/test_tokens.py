"""Token ids against the library, bit packing, token files and packing into windows."""

import os
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from messy import frame, messy_rows, texts  # noqa: E402

from pathgram.llm.encoding import Encoder  # noqa: E402
from pathgram.llm.packing import best_fit_decreasing, fill_up, pack_documents, powers_of_two  # noqa: E402
from pathgram.llm.queries import END_ID, vocabulary  # noqa: E402
from pathgram.llm.token_files import pack, read_documents, read_ids, token_table, unpack, write_tokens  # noqa: E402

PATH = vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
CODER = Encoder(PATH)


def library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aBcé ÉßİΣς'.,!? \n\t19<|endoftext|>̈ ​\x1c\x85ΩΩ", max_size=60)))
def test_words_encode_as_whole_texts(text):
    assert CODER.ids(text, END_ID).tolist() == library(text)


def test_special_strings_and_long_words():
    for text in ("<|endoftext|> a", "x<|startoftext|>y <|endo ftext|>", "don't I'll we've", "a" * 3000, "ab,cd. EF!!", "AbC" * 500 + "\n" + "é" * 900):
        assert CODER.ids(text, END_ID).tolist() == library(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_vocabularies_with_white_space_are_encoded_whole(name):
    coder, tokenizer = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    for text in texts():
        assert coder.ids(text, END_ID).tolist() == [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), END_ID]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=60), st.data())
def test_packing_bits_round_trip(bits, ids, data):
    ids = np.array([i % (1 << bits) for i in ids], np.uint32)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert unpack(pack(ids, bits), bits, a, b).tolist() == ids[a:b].tolist()


def test_token_table(spark):
    docs = frame(spark)
    rows = token_table(docs, PATH, END_ID).collect()
    given_rows = sorted(messy_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((str(r.doc_id), r.ids_crc32, r.n_tokens) for r in rows) == sorted((str(d), crc(library(t)), len(library(t))) for d, t, _ in given_rows)
    rows.sort(key=lambda r: r.start)
    ends = np.cumsum([r.n_tokens for r in rows]).tolist()
    assert [r.start for r in rows] == [0, *ends[:-1]]
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_files_allow_random_access(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    write_tokens(frame(spark, [(i, t, "s") for i, t in enumerate(texts())]), PATH, END_ID, path, block_ids=500, shards=2)
    blocks = spark.read.parquet(path)
    assert blocks.count() > 4
    for shard in (0, 1):
        one = blocks.filter(f"shard = {shard}").orderBy("base").collect()
        every = np.concatenate([unpack(b.payload, b.bits, 0, b.n_ids) for b in one])
        assert read_ids(spark, path, shard, 450, 1300).tolist() == every[450:1300].tolist()
    assert read_documents(spark, path).count() == len(texts())


def test_empty_tables(spark):
    assert token_table(frame(spark, []), PATH, END_ID).count() == 0
    assert pack_documents(frame(spark, []), PATH, END_ID).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit(sizes):
    pieces = [(i, 0, n) for i, n in enumerate(sizes)]
    windows = best_fit_decreasing(pieces, 64)
    assert sorted(p for w in windows for p in w) == sorted(pieces)
    # The same by looking at every window.
    rooms = []
    for n in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(64 - n)
    assert sorted(64 - sum(p[2] for p in w) for w in windows) == sorted(rooms)
    filled = fill_up(windows, 64)
    assert sum(sum(p[2] for p in w) < 64 for w in filled) <= 1
    cover(filled, dict(enumerate(sizes)))
    if filled:
        tail = powers_of_two(filled[-1], 4)
        assert all((s := sum(p[2] for p in w)) & (s - 1) == 0 or s < 4 for w in tail)


def cover(windows, sizes):
    parts = defaultdict(list)
    for w in windows:
        assert 0 < sum(p[2] for p in w) <= 64
        for doc, start, length in w:
            parts[doc].append((start, length))
    for doc, size in sizes.items():
        at = 0
        for start, length in sorted(parts[doc]):
            assert start == at and length > 0
            at += length
        assert at == size


@pytest.mark.parametrize("round_ids", [1 << 21, 3000])
def test_packed_documents(spark, round_ids):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    pieces = pack_documents(frame(spark, rows), PATH, END_ID, window=1024, round_ids=round_ids).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, text, _ in rows:
        ids, at = library(text), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    padding = 0
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 3 * 1024  # one short window for each task


def test_rows_that_repeat_are_packed_each(spark):
    pieces = pack_documents(frame(spark), PATH, END_ID).collect()
    assert sum(p.length for p in pieces) == sum(len(library(t)) for _, t, _ in messy_rows())
