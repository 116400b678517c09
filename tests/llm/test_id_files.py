"""Token-id files: exact round trips of the coder and of whole tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendalloc.llm import id_coder, id_files

from .data import SCHEMA, frame, result, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 70000), st.just(2 ** 32 - 2)), max_size=200))
def test_round_trip(ids):
    got = id_coder.decode(id_coder.split(b"".join(id_coder.encode(np.array(ids, np.uint32)))))
    assert [int(x) for b in got for x in b] == ids


def test_blocks_stand_alone_and_are_checked():
    g = np.random.default_rng(1)
    ids = (g.zipf(1.2, 3 * id_coder.BLOCK + 7) % 40000).astype(np.uint32)
    wide = g.integers(0, 1 << 31, 50).astype(np.uint32)
    blocks = id_coder.encode(ids)
    assert len(blocks) == 4
    got = id_coder.decode([blocks[3], *id_coder.encode(wide), blocks[1]])
    assert np.array_equal(got[0], ids[3 * id_coder.BLOCK:]) and np.array_equal(got[1], wide)
    assert np.array_equal(got[2], ids[id_coder.BLOCK:2 * id_coder.BLOCK])
    assert sum(map(len, blocks)) < 2 * len(ids)  # shorter than 16 bits for each id
    bad = bytearray(blocks[2])
    bad[-9] ^= 1
    with pytest.raises(ValueError):
        id_coder.decode([bytes(bad)])
    with pytest.raises(ValueError):
        id_coder.decode([blocks[2][:-2]])


def test_repetition_is_learned():
    ids = np.tile(np.arange(100, 150, dtype=np.uint32), 40)
    assert sum(map(len, id_coder.encode(ids))) < len(ids) / 4


@pytest.mark.parametrize("segment", [1 << 21, 500])
def test_whole_table(spark, monkeypatch, segment):
    from tokenizers import Tokenizer

    monkeypatch.setattr(id_files, "SEGMENT", segment)
    monkeypatch.setattr(id_files, "PART_BYTES", 20_000)
    lib = Tokenizer.from_file(PATH)
    want, start = [], 0
    docs = [(i, t or "") for i, t, *_ in rows()]
    ids = {t: lib.encode(t, add_special_tokens=False).ids + [2] for _, t in docs}
    got = id_files.id_files(frame(spark), PATH)
    assert result(got, "doc_id", "n_tokens", "ids_crc32") == sorted(
        ((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in docs), key=repr)
    # Starts follow the order of ids; nothing is between two documents.
    at = 0
    for r in sorted(got.collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        want.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert want == sorted(want) and at == sum(len(ids[t]) for _, t in docs)
    assert id_files.id_files(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_ids_can_be_read(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(2, "some text"), (1, "more, of it")], "doc_id long, text string")
    files = id_files.write_ids(docs, PATH, str(tmp_path / "files"), end_id=70000)
    got = {r["doc_id"]: r["ids"] for r in id_files.read_documents(files, with_ids=True).collect()}
    assert got == {1: lib.encode("more, of it").ids + [70000], 2: lib.encode("some text").ids + [70000]}
