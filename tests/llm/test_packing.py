"""Packing: conservation, room, and the best-fit rule against a plain list of bins."""

import random

from spendalloc.llm import packing

from .data import SCHEMA, frame, rows


def test_best_fit_rule():
    r = random.Random(4)
    for caps in ((16,), (8, 16, 32), (5, 64)):
        lengths = sorted((r.randint(0, max(caps)) for _ in range(300)), reverse=True)
        places, capacity, used = packing.pack(lengths, caps)
        room, opened = {}, {}
        for i, (n, (b, at)) in enumerate(zip(lengths, places)):
            fits = [x for x in room.values() if x >= n]
            if b in room:
                assert room[b] == min(fits)  # the fullest bin with room
                room[b] -= n
            else:
                assert not fits and at == 0
                # The size it was opened with is told by what is packed later; at least the piece fits.
                rest = lengths[i + 1:]
                left = {x: rest.count(x) for x in set(rest)}
                best = min((packing.bin_cost(c) / max(1, n + packing._could_fill(c - n, sorted(left), left)), c)
                           for c in caps if c >= n)
                opened[b] = best[1]
                room[b] = best[1] - n
        for b, c in enumerate(capacity):
            assert used[b] == opened[b] - room[b] <= c
            assert c == min(x for x in caps if x >= used[b])


def test_could_fill_is_greedy():
    assert packing._could_fill(10, [3, 4, 7], {3: 2, 4: 1, 7: 1}) == 10
    assert packing._could_fill(10, [6], {6: 3}) == 6
    assert packing._could_fill(9, [4, 5], {4: 2, 5: 0}) == 8


def check(got, want_lengths, caps):
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["bin_id"], []).append(r)
    assert sorted((sum(r["length"] for r in got if r["doc_id"] == d), d) for d in by_doc if d is not None) == sorted(
        (n, d) for d, n in want_lengths.items() if d is not None)
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: (r["bin_offset"], r["length"])):
            assert r["bin_offset"] == at
            at += r["length"]
        assert {r["bin_used"] for r in rs} == {at}
        assert {r["bin_capacity"] for r in rs} == {min(c for c in caps if c >= at)}


def test_whole_table(spark):
    want = {}
    for i, t, *_ in rows():
        want[i] = want.get(i, 0) + len((t or "").encode().split())
    for group_rows in (10, 10_000):
        got = packing.best_fit_packing(packing.word_lengths(frame(spark)), (64, 256), group_rows=group_rows).collect()
        check(got, want, (64, 256))
        assert len([r for r in got if r["piece"] == 0]) == len(rows())
    assert packing.best_fit_packing(packing.word_lengths(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_packs_tokens_of_texts_with_and_without_white_space(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from spendalloc.llm.queries import QUERIES

    texts = ["日本語の文章" * 900, "q7Zx+/" * 2000, "ordinary words stand here, unlike " * 20, None, "", "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert max(want.values()) > max(packing.CAPACITIES)
    got = QUERIES["op7_best_fit_packing"](spark, str(tmp_path)).collect()
    check(got, want, packing.CAPACITIES)
    for i in want:
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"]):
            assert r["start"] == at
            at += r["length"]
