"""Byte-pair encoding and decoding of whole texts with a public byte-level vocabulary file.

A text is cut into pieces (words with the space before them, numbers, marks,
white space). A piece is encoded by a contiguous rank array: the ids of its
parts, their boundaries and the rank of each adjacent pair lie in arrays; the
array is scanned for its minimum, the boundary there is deleted and the ranks on
both sides are looked up anew, until no pair has a rank. Pieces of more than
`LONG` bytes, for which scanning would grow with the square of their length,
keep their pairs in a heap; the merges are the same. Pieces met before come
from a bounded memo.

Ids are little-endian unsigned 32-bit integers in a binary column. Special
strings of the file inside a text become their ids. Null and empty texts have no
ids; null ids have the empty text. Ids that the file lacks decode to nothing.
Repeated rows each get a row, null doc_ids stay, texts of any length are encoded
whole, an empty table gives an empty result, and other columns are ignored."""

import heapq
import json
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, table
from .encoders import _LETTERS, BYTE_SPLIT, load_file

LONG = 256
MEMO_PIECES = 200_000
_NONE = 1 << 40
# Scripts whose letters, digits and white space are the same in all editions of the Unicode tables since 2010.
_OTHER = re.compile("[^\x00-\u04ff\u2000-\u2070\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]")


class BytePairs:
    """The tables of one vocabulary file."""

    def __init__(self, content: bytes):
        config = json.loads(content)
        model, split = config["model"], config.get("pre_tokenizer") or {}
        added = config.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                           "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
        if (model.get("type") != "BPE" or odd or config.get("normalizer") or split.get("type") != "ByteLevel"
                or not split.get("use_regex") or split.get("add_prefix_space")):
            raise ValueError(f"not a plain byte-level file of byte pairs {odd}")
        vocab, letters = model["vocab"], {chr(v): k for k, v in _LETTERS.items()}
        self.first = [vocab[chr(_LETTERS[b])] for b in range(256)]
        # A pair of ids is one number, left above right.
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        spelled = dict(vocab)
        self.special = {}
        for t in added:
            spelled[t["content"]] = self.special[t["content"]] = t["id"]
        self.spelling = [b""] * (max(spelled.values()) + 1)
        for token, i in spelled.items():
            plain = all(c in letters for c in token)
            self.spelling[i] = bytes(letters[c] for c in token) if plain else token.encode()
        self.cut = regex.compile(BYTE_SPLIT).findall
        self.at_special = re.compile("(" + "|".join(
            re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.content, self.library, self.memo = content, None, {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.first[b] for b in piece]
        if len(ids) > LONG:
            return self._merge_long(ids)
        rank = self.ranks.get
        ranks = [rank(a << 32 | b, _NONE) for a, b in pairwise(ids)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = self.merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges, with the pairs in a heap by rank and place; a pair that is gone is passed over."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = self.ranks.get
        heap = [(r, i) for i, (a, b) in enumerate(pairwise(ids)) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0:
                    new = rank(ids[left] << 32 | ids[after[left]])
                    if new is not None:
                        heapq.heappush(heap, (new, left))
        return [i for i in ids if i >= 0]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text without special strings; rarer scripts are cut by the library, whose letter tables count."""
        if not _OTHER.search(text):
            return self.cut(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content.decode()).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _bytes(self, text: str) -> bytes:
        memo, out = self.memo, []
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
                if len(piece) <= LONG:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not self.at_special.search(text):
            return self._bytes(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._bytes(p)
                        for i, p in enumerate(self.at_special.split(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids, special strings included; bytes that are no UTF-8 become replacement characters."""
        ids = np.frombuffer(ids, "<u4")
        known = ids[ids < len(self.spelling)].tolist()
        return b"".join(map(self.spelling.__getitem__, known)).decode("utf-8", "replace")


_LOADED: dict[str, BytePairs] = {}


def _loaded(content, version) -> BytePairs:
    """One set of tables per file and worker, so that the memo serves all batches."""
    if version not in _LOADED:
        _LOADED.clear()
        _LOADED[version] = BytePairs(content.value)
    return _LOADED[version]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary) for every row; nothing is shuffled."""
    _, content, version = load_file(path)
    content = docs.sparkSession.sparkContext.broadcast(content)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        pairs = _loaded(content, version)
        for b in cut(batches):
            yield table(schema, doc_id=b.column("doc_id"), ids=[pairs.encode(t) for t in b.column("text").to_pylist()])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text for every row of a table with doc_id and ids."""
    _, content, version = load_file(path)
    content = encoded.sparkSession.sparkContext.broadcast(content)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches):
        pairs = _loaded(content, version)
        for b in cut(batches, "ids"):
            yield table(schema, doc_id=b.column("doc_id"), ids=b.column("ids"),
                        text=[pairs.decode(i) for i in b.column("ids").to_pylist()])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids binary, text string")
