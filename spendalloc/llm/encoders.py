"""Encoding whole texts with a public tokenizer file, each distinct word once per worker.

The library spends its time on splitting texts. Where the file's normaliser and
splitter are ones whose words do not depend on their neighbours, and a text has
only characters about which all regular expression libraries agree, words are
looked up in a bounded memo that the library's model fills. All other texts are
given to the library whole. Results are the library's in either case."""

import hashlib
import json
import os
import re

import numpy as np
import regex

MEMO_WORDS = 700_000
MAX_FILE_BYTES = 64 << 20

# The splitters of the two known kinds of file.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Latin, digits, ASCII marks and common white space; other texts go to the library whole.
_UNUSUAL = re.compile("[^\t-\r -~\xa0-ɏ–—‘-”]")
_RUN = re.compile("([\t-\r \xa0]{2,})")


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word):
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self.encode(word)
        if len(word) <= 200:
            self[word] = value
        return value


def load_file(path: str) -> tuple[str, bytes, str]:
    """Kind, content and version digest of a tokenizer file (at most 64 MB, so that it may be sent to tasks)."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError("tokenizer file is too large to send to tasks")
    with open(path, "rb") as f:
        content = f.read()
    kind = "pieces" if path.endswith(".model") else "json"
    if kind == "json":
        import tokenizers as library
    else:
        import sentencepiece as library
    return kind, content, hashlib.sha256(content + f"|{library.__version__}".encode()).hexdigest()


def _is_words(config: dict) -> bool:
    """Lower-cased words, white space removed, no piece spans white space."""
    norm, split = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps, parts = norm.get("normalizers") or [], split.get("pretokenizers") or []
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0].get("pattern") == {"Regex": WORD_SPLIT}
        and parts[0].get("behavior") == "Removed" and bool(parts[0].get("invert"))
        and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex"))


def _is_bytes(config: dict) -> bool:
    """Byte-level pieces with the usual splitter: a piece takes at most one space, in front."""
    split = config.get("pre_tokenizer") or {}
    return (not config.get("normalizer") and split.get("type") == "ByteLevel" and bool(split.get("use_regex"))
            and not split.get("add_prefix_space"))


def _byte_letters() -> dict:
    """Printable letter of each byte, as byte-level vocabularies spell them: printable Latin-1 stands for itself,
    the others follow from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, or their number; no added special tokens."""

    def __init__(self, kind: str, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if kind == "pieces":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self._encode, self._special, self._mode = (lambda t: model.encode(t, num_threads=1)), [], "whole"
        else:
            from tokenizers import Tokenizer

            text = content.decode()
            library, config = Tokenizer.from_str(text), json.loads(text)
            library.no_truncation()
            library.no_padding()
            self._encode = lambda t: library.encode(t, add_special_tokens=False).ids
            self._special = [t["content"] for t in config.get("added_tokens", [])]
            self._mode = "words" if _is_words(config) else "bytes" if _is_bytes(config) else "whole"
            self._model, self._normal = library.model, library.normalizer
            self._split = regex.compile(WORD_SPLIT if self._mode == "words" else BYTE_SPLIT)
        self._ids = _Memo(lambda w: np.array(self._word(w), "<u4").tobytes())
        self._counts = _Memo(lambda w: len(self._word(w)))

    def _word(self, word: str) -> list:
        """Ids of one word, through the library's normaliser and model."""
        if self._mode == "words":
            word = word.lower() if word.isascii() else self._normal.normalize_str(word)
        ids = []
        for piece in self._split.findall(word):
            ids += [t.id for t in self._model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]
        return ids

    def _words(self, text: str):
        """The text as words that the library encodes alike alone and in place, or None."""
        if self._mode == "whole" or _UNUSUAL.search(text) or any(s in text for s in self._special):
            return None
        if self._mode == "words":
            return text.split()
        words = []
        parts = _RUN.split(text)
        before = ""
        # A run of white space leaves its last character to what follows it.
        for i in range(0, len(parts), 2):
            part = before + parts[i]
            run = parts[i + 1] if i + 1 < len(parts) else ""
            follows = i + 2 < len(parts) and parts[i + 2] != ""
            if part:
                for j, line in enumerate(part.split("\n")):
                    if j:
                        words.append("\n")
                    first, *rest = line.split(" ")
                    if first:
                        words.append(first)
                    words += [" " + r for r in rest]
            if run:
                words.append(run[:-1] if follows else run)
            before = run[-1] if run and follows else ""
        return words

    def ids(self, text: str) -> bytes:
        words = self._words(text)
        if words is None:
            return np.array(self._encode(text), "<u4").tobytes()
        return b"".join(map(self._ids.__getitem__, words))

    def count(self, text: str) -> int:
        words = self._words(text)
        return len(self._encode(text)) if words is None else sum(map(self._counts.__getitem__, words))


_LOADED: dict = {}


def encoder(kind: str, content: bytes, digest: str) -> Encoder:
    """One encoder per tokenizer and worker, so that the memo serves all batches of a worker."""
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Encoder(kind, content)
    return _LOADED[digest]
