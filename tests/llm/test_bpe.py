"""Byte-pair encoding against the library that the vocabulary file is for."""

import random

import numpy as np
import public_tokenizers
import pytest

from spendalloc.llm import bpe

from .data import SCHEMA, frame, plain, result, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    return lib


def check(spark, library, docs, texts):
    whole = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH)
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in whole.collect()), key=repr)
    ids = {t: library.encode(t, add_special_tokens=False).ids for _, t in texts}
    assert got == sorted(((i, ids[t], library.decode(ids[t], skip_special_tokens=False)) for i, t in texts), key=repr)


def test_odd_rows(spark, library):
    check(spark, library, frame(spark), [(r[0], r[1] or "") for r in rows()])


def test_all_kinds_of_characters(spark, library):
    """Every white space, marks, contractions, many scripts, special strings, and characters that are new in Unicode."""
    r = random.Random(5)
    pool = list("aZ09'st!?.  \n\t\r\x00\x1c\x1f\x85\xa0") + [" ", "　", " ", "﻿", "՘", "౜",
           "\U0001e6c0", "\U00012480", "é", "ß", "Ж", "中", "か", "한", "ا", "\U0001f600", "�", "'ll", "'re", "²", "Ⅷ",
           "<|endoftext|>", "<|endoftext", "  ", "\n\n "]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    check(spark, library, plain(spark, texts), list(enumerate(texts)))


def test_long_pieces_merge_alike(spark, library):
    """Pieces on both sides of the length from which a heap is used."""
    r = random.Random(9)
    texts = ["".join(r.choice("abcdeinorst") for _ in range(n)) for n in (255, 256, 257, 900, 60000)]
    texts += ["a" * 70001, "ab" * 40000, "!" * 3000, " " * 5000 + "x"]
    check(spark, library, plain(spark, texts), list(enumerate(texts)))
    pairs = bpe.BytePairs(open(PATH, "rb").read())
    for n in (2, 3, 40, 250):
        piece = bytes(r.choice(b"eeaoinsth ") for _ in range(n))
        assert pairs.merge(piece) == pairs._merge_long([pairs.first[b] for b in piece])


def test_unknown_ids_and_parts_of_characters(spark, library):
    ids = [3, 60000, 95, 2**32 - 1, 256 + 172, 30]
    made = spark.createDataFrame([(1, bytearray(np.array(ids, "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    got = result(bpe.bpe_decode(made, PATH), "doc_id", "text")
    assert got == [(1, library.decode([i for i in ids if i < 50257], skip_special_tokens=False)), (2, "")]


def test_empty_table_and_other_files(spark):
    assert bpe.bpe_encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.BytePairs(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
