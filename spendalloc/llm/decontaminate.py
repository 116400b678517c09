"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words. Over the benchmark's terms,
with document frequencies of all documents, a randomised singular value
decomposition of TF-IDF passages (subspace iteration, each product a Spark job)
gives a latent space. A passage leaks an item when the longest common
subsequence of words with it is long, or is fair and the answer's words stand
there too. Candidates are the items whose latent cosine with a passage, or with
a half of it, is at least `min_cosine`; among them a paraphrase with a shorter
subsequence (`far_lcs`) also leaks where the answer stands. What the cosine
misses is found exactly (`complete`): all passages around which at least as many
of the item's words stand as a fair subsequence has, counted by an index from
words to items.

The space is fitted on the passages of all documents (of about `fit_docs`, those
with the smallest hash of the id, where a caller asks for it); frequencies,
passages and candidates cover whole texts of all rows. Items are taken in blocks
of about `block_items`, so what is sent to tasks has a bound. Null and empty texts leak nothing; items with fewer than
`min_words` words leak only where all their words stand one after the other. In
scripts without spaces a character is a word. Rows that repeat an id are one document. An
empty table gives an empty result; extra columns are ignored."""

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, share, stash, table
from .license_scan import words_of

HALF = 32  # words of half a passage
FEATURES = 1 << 13
_SLICE = 512
_BATCH_BYTES = 1 << 20  # of texts whose words are held at a time
_CHUNKS = 64  # half passages whose vectors are compared at a time
_GROUP = 16  # passages to fit on in a row
_OFTEN = 512  # features that are multiplied as a matrix
_PAIRS = "doc_id long, item_id long, cosine double, lcs double, answer_found boolean, start_word long"


# Scripts written without spaces (Thai, Lao, Burmese, Khmer, Japanese, Chinese) and their marks.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u9fff\uf900-\ufaff\uff00-\uffef"
                       "\U00020000-\U0003ffff]")


def tokens(text: str) -> list[bytes]:
    """Lower-cased words; each character of a script without spaces is a word."""
    text = text.lower()
    return words_of(text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text))


def consecutive(a: list, b: list) -> bool:
    """Whether the words of `a` stand in `b` one after the other."""
    return any(b[i:i + len(a)] == a for i in range(len(b) - len(a) + 1))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one bit of an integer for each word of `a`."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    state = (1 << len(a)) - 1
    full = state
    for w in b:
        u = state & masks.get(w, 0)
        state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def answer_of(text: str, given: str | None) -> list[bytes]:
    """The answer's words: as given, else those of the last sentence."""
    if given:
        return tokens(given)
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if tokens(p)]
    return tokens(parts[-1]) if parts else []


def _frequencies(vocabulary):
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        seen = Counter()
        for b in cut(batches):
            for t in b.column("text").to_pylist():
                seen.update(vocabulary.intersection(tokens(t)))
        yield table(schema, word=list(seen), n=list(seen.values()))
    return run


def _weights(at: np.ndarray, f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of the features of passages, of length one in each; `at` numbers the passages."""
    w = n * idf[f]
    return w / np.maximum(np.sqrt(np.bincount(at, w * w)), 1e-12)[at]


def _weighted(ids: np.ndarray, idf: np.ndarray):
    """Distinct features of a passage with TF-IDF weights of length one."""
    f, n = np.unique(ids, return_counts=True)
    return f, _weights(np.zeros(len(f), np.int64), f, n, idf)


def _passages(vocab):
    """Feature numbers of each passage of the documents to fit on."""
    schema = pa.schema([("terms", pa.list_(pa.int32()))])

    def run(batches):
        for b in cut(batches, size=_BATCH_BYTES):
            out = [np.zeros(0, np.int32)]
            for t in b.column("text").to_pylist():
                ids = np.array(list(map(vocab.get, tokens(t), repeat(-1))), np.int32)
                for at in range(0, max(1, len(ids) - HALF), HALF):
                    known = ids[at:at + 2 * HALF]
                    known = known[known >= 0]
                    if len(known):
                        out.append(known)
            ends = np.cumsum([len(x) for x in out]).astype(np.int32)
            yield table(schema, terms=pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out))))
    return run


def _blocks(batches):
    """Distinct features of `_GROUP` passages in a row: passage, feature and number as arrays; `n` is the number of passages."""
    schema = pa.schema([("n", pa.int64()), ("at", pa.binary()), ("f", pa.binary()), ("times", pa.binary())])
    for b in cut(batches, None):
        terms = b.column("terms")
        sizes = np.diff(terms.offsets.to_numpy())
        key, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * FEATURES + terms.flatten().to_numpy(), return_counts=True)
        at, f = np.divmod(key, FEATURES)
        firsts = range(0, len(sizes), _GROUP)
        ends = np.searchsorted(at, firsts)[1:]
        parts = lambda x: [v.tobytes() for v in np.split(x, ends)]
        yield table(schema, n=[min(_GROUP, len(sizes) - i) for i in firsts], at=parts((at % _GROUP).astype(np.uint8)),
                    f=parts(f.astype(np.uint16)), times=parts(times.astype(np.int32)))


def _gram(m, idf):
    """A'A m over a task's passages, in slices of features.

    The commonest features make up most entries: they are multiplied as a
    matrix, the others entry by entry."""
    schema = pa.schema([("part", pa.int64()), ("sums", pa.binary())])
    often = np.argsort(idf, kind="stable")[:_OFTEN]
    column = np.full(len(idf), -1)
    column[often] = np.arange(len(often))

    def run(batches):
        total = np.zeros_like(m)
        for b in cut(batches, None, rows=64):
            at, f, n = (np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (
                ("at", np.uint8), ("f", np.uint16), ("times", np.int32)))
            at = at + _GROUP * np.repeat(np.arange(b.num_rows), [len(x) for x in b.column("at").to_pylist()])
            w = _weights(at, f, n, idf)
            c = column[f]
            known = c >= 0
            common = np.zeros((_GROUP * b.num_rows, len(often)))
            common[at[known], c[known]] = w[known]
            y = common @ m[often]
            at, f, w = at[~known], f[~known], w[~known, None]
            if len(f):
                # Entries come by passage, so those of a passage stand together.
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                y[at[first]] += np.add.reduceat(m[f] * w, first)
                order = np.argsort(f, kind="stable")
                terms, first = np.unique(f[order], return_index=True)
                total[terms] += np.add.reduceat(y[at[order]] * w[order], first)
            total[often] += common.T @ y
        for i in range(0, len(m), _SLICE):
            if total[i:i + _SLICE].any():
                yield table(schema, part=[i // _SLICE], sums=[total[i:i + _SLICE].tobytes()])
    return run


def _times(passages: DataFrame, m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'A m; what reaches the driver is as large as m, which has a fixed bound."""
    width = m.shape[1]

    def add(pdf):
        part = pdf["part"].iloc[0]
        sums = sum(np.frombuffer(s, float) for s in pdf["sums"])
        pdf = pdf.iloc[:1].copy()
        pdf["part"], pdf["sums"] = part, [sums.tobytes()]
        return pdf

    out = np.zeros_like(m)
    parts = passages.mapInArrow(_gram(m, idf), "part long, sums binary").groupBy("part").applyInPandas(
        add, "part long, sums binary")
    for r in parts.toLocalIterator():
        block = np.frombuffer(r["sums"], float).reshape(-1, width)
        out[r["part"] * _SLICE:r["part"] * _SLICE + len(block)] = block
    return out


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int, items: list | None = None, rounds: int = 2,
                 seed: int = 7) -> np.ndarray:
    """Right singular vectors (features x rank) of the TF-IDF passages, by randomised subspace iteration.

    `items` are the features of the benchmark's items, which weigh as much as
    all the passages, so that the space tells items apart and not only the
    commonest words."""
    width = min(rank + 8, len(idf))
    own = np.zeros((len(items or ()), len(idf)))
    for i, ids in enumerate(items or ()):
        f, w = _weighted(np.array(ids), idf)
        own[i, f] = w
    blocks = stash(passages.mapInArrow(_blocks, "n long, at binary, f binary, times binary"), "passages")
    scale = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] / max(1, len(own))
    times = lambda m: _times(blocks, m, idf) + scale * (own.T @ (own @ m))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(idf), width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times(q))[0]
    values, vectors = np.linalg.eigh(q.T @ times(q))
    keep = np.argsort(-values)[:rank]
    return q @ vectors[:, keep[values[keep] > 1e-9]]


class _Items:
    def __init__(self, rows, number, idf, space, fair_lcs, min_words, min_cosine):
        self.ids = [r[0] for r in rows]
        self.words = [tokens(r[1]) for r in rows]
        self.answers = [answer_of(r[1], r[2]) for r in rows]
        # The last row is that of words that no item has.
        self.terms = np.append(space * idf[:, None], np.zeros((1, space.shape[1])), axis=0).astype(np.float32)
        self.min_cosine = min_cosine
        folded = [[number[w] % FEATURES for w in ws] for ws in self.words]
        v = np.stack([self.terms[f].sum(0) for f in folded])
        self.vectors = (v / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]).astype(np.float32)
        # Places of an item whose word must stand in a region: the subsequence cannot be longer than their number.
        self.sizes = np.array([len(ws) for ws in self.words])
        self.need = np.ceil(self.sizes * fair_lcs - 1e-9).astype(np.int64)
        self.need = np.where(self.sizes < min_words, self.sizes, self.need)
        self.distinct = [np.unique([number[w] for w in ws], return_counts=True) for ws in self.words]
        # By word: the items that have it, and how often.
        word = np.concatenate([x[0] for x in self.distinct])
        order = np.argsort(word, kind="stable")
        self.holders = np.repeat(np.arange(len(rows)), [len(x[0]) for x in self.distinct])[order]
        self.times = np.concatenate([x[1] for x in self.distinct])[order]
        self.first = np.searchsorted(word[order], np.arange(len(number) + 1))

    def overlapping(self, ids: np.ndarray) -> np.ndarray:
        """Items of which enough words stand somewhere among these."""
        words = np.unique(ids)
        words = words[words >= 0]
        n = self.first[words + 1] - self.first[words]
        at = np.repeat(self.first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.flatnonzero(np.bincount(self.holders[at], self.times[at], len(self.ids)) >= self.need)

    def near(self, texts: list):
        """(text, half passage, item) where the cosine of a passage, or of its first half, is at least `min_cosine`.

        The texts' words are laid in rows of half a passage, with an empty row after each text."""
        starts = np.cumsum([0] + [len(ids) // HALF + 2 for ids in texts])
        rows = np.full((starts[-1], HALF), len(self.terms) - 1)
        for ids, at in zip(texts, starts):
            rows[at:].reshape(-1)[:len(ids)] = np.where(ids < 0, len(self.terms) - 1, ids % FEATURES)
        for begin in range(0, len(rows), _CHUNKS):
            # One half more than are answered for: a passage is a half and the next one.
            v = self.terms[rows[begin:begin + _CHUNKS + 1]].sum(1)
            dots, norms = v @ self.vectors.T, np.einsum("ij,ij->i", v, v)
            both = norms[:-1] + norms[1:] + 2 * np.einsum("ij,ij->i", v[:-1], v[1:])
            hit = dots >= self.min_cosine * np.maximum(np.sqrt(norms), 1e-9)[:, None]
            hit[:-1] |= dots[:-1] + dots[1:] >= self.min_cosine * np.maximum(np.sqrt(np.maximum(both, 0)), 1e-9)[:, None]
            at, k = np.nonzero(hit)
            text = np.searchsorted(starts, at + begin, "right") - 1
            yield from zip(text.tolist(), (at + begin - starts[text]).tolist(), k.tolist())

    def cosine(self, ids: np.ndarray, k: int) -> float:
        v = self.terms[ids[ids >= 0] % FEATURES].sum(0)
        return float(v @ self.vectors[k] / max(np.sqrt(v @ v), 1e-9))


def _search(items: "_Items", number, min_lcs, fair_lcs, min_answer, min_words, far_lcs, complete):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()),
                        ("lcs", pa.float64()), ("answer_found", pa.bool_()), ("start_word", pa.int64())])
    row = np.zeros(len(number), np.int64)  # how often an item has each word

    longest = int(items.sizes.max())
    span = max(12, 8 * longest // HALF)

    def candidates(ids):
        """(half passage, item) of all passages around which enough words of the item stand."""
        last = len(ids) // HALF
        # Some passages at a time, with all words of their regions: in a long text most items have their common words.
        for begin in range(0, last + 1, span):
            end = min(begin + span - 1, last)
            start = max(0, begin * HALF - longest)
            here = ids[start:(end + 2) * HALF + longest]
            found = items.overlapping(here)
            if not len(found):
                continue
            known = np.flatnonzero(here >= 0)
            here = here[known]
            # The place where each word stood before.
            order = np.argsort(here, kind="stable")
            before = np.full(len(here), -1)
            same = here[order[1:]] == here[order[:-1]]
            before[order[1:][same]] = known[order[:-1][same]] + start
            for k in found.tolist():
                n = int(items.sizes[k])
                words, times = items.distinct[k]
                row[words] = times
                hits = row[here]
                row[words] = 0
                at = np.flatnonzero(hits)
                times, seen, place = hits[at], before[at], known[at] + start
                # A word stands in the regions of passages `lo` to `hi`; it counts once in each.
                lo = np.maximum((place - 2 * HALF - n) // HALF + 1, begin)
                lo = np.where(seen >= 0, np.maximum(lo, (seen + n) // HALF + 1), lo) - begin
                hi = np.minimum((place + n) // HALF, end) - begin
                fits = lo <= hi
                lo, hi, times = lo[fits], hi[fits], times[fits]
                steps = np.bincount(lo, times, span + 1) - np.bincount(hi + 1, times, span + 1)
                for at in np.flatnonzero(np.cumsum(steps)[:end - begin + 1] >= items.need[k]).tolist():
                    yield begin + at, k

    def run(batches):
        for b in cut(batches, size=_BATCH_BYTES):
            rows = []
            texts = [tokens(t) for t in b.column("text").to_pylist()]
            numbers = [np.array(list(map(number.get, words, repeat(-1))), np.int64) for words in texts]
            by_text = [set() for _ in texts]
            for i, at, k in items.near(numbers):
                by_text[i].add((at, k))
            for doc, words, ids, near in zip(b.column("doc_id").to_pylist(), texts, numbers, by_text):
                best = {}
                for at, k in sorted(near.union(candidates(ids) if complete else ())):
                    want, answer = items.words[k], items.answers[k]
                    lo = max(0, at * HALF - len(want))
                    region = words[lo:(at + 2) * HALF + len(want)]
                    if len(want) < min_words and not consecutive(want, region):
                        continue
                    share = common_subsequence(want, region) / len(want)
                    if share < (far_lcs if (at, k) in near else fair_lcs):
                        continue
                    answered = bool(answer) and common_subsequence(answer, region) >= min_answer * len(answer)
                    if share >= min_lcs or answered:
                        key = (share, answered, items.cosine(ids[at * HALF:(at + 2) * HALF], k), -lo)
                        if k not in best or key > best[k]:
                            best[k] = key
                rows += [(doc, items.ids[k], c, s, a, -lo) for k, (s, a, c, lo) in best.items()]
            if rows:
                yield table(schema, **dict(zip(schema.names, map(list, zip(*rows)))))
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, rank: int = 192, min_lcs: float = 0.75,
                  fair_lcs: float = 0.6, min_answer: float = 0.8, fit_docs: int | None = None, min_words: int = 5,
                  block_items: int = 1000, min_cosine: float = 0.5, far_lcs: float = 0.45, complete: bool = True,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer_found, start_word: a row for each document and item that leaks into it.

    lcs is the longest common subsequence as a share of the item's words.
    Without `complete` the cosine alone finds candidates."""
    spark = docs.sparkSession
    d = id_text(docs, id_col, text_col)
    given = F.col(answer_col) if answer_col else F.lit(None)
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"),
                             given.cast("string").alias("answer")).filter("text IS NOT NULL")
    n_docs, n_items = d.count(), bench.count()
    found = spark.createDataFrame([], _PAIRS)
    blocks = -(-n_items // block_items)
    for k in range(blocks):
        # Some items at a time: a bounded query set against all documents.
        rows = [tuple(r) for r in bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        rows = sorted((r for r in rows if tokens(r[1])), key=repr)
        if not rows or not n_docs:
            continue
        names = sorted({w for r in rows for w in tokens(r[1])})
        number = {w: i for i, w in enumerate(names)}
        vocab = {w: i % FEATURES for w, i in number.items()}
        df = d.mapInArrow(_frequencies(frozenset(vocab)), "word binary, n long").groupBy("word").agg(
            F.sum("n").alias("n")).collect()  # as many rows as the block has terms, whatever the corpus
        n = np.zeros(min(len(names), FEATURES))
        for r in df:
            n[vocab[bytes(r["word"])]] += r["n"]
        idf = (np.log((n_docs + 1) / (np.minimum(n, n_docs) + 1)) + 0.05) ** 2
        fit = d
        if fit_docs is not None:
            place = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
            fit = d.filter(place < fit_docs / n_docs)
        fit = fit.select("text").unionByName(spark.createDataFrame([(r[1],) for r in rows], "text string"))
        passages = fit.mapInArrow(_passages(vocab), "terms array<int>")
        space = latent_space(passages, idf, rank, [[vocab[w] for w in tokens(r[1])] for r in rows])
        items = _Items(rows, number, idf, space, fair_lcs, min_words, min_cosine)
        shared = share(spark, (items, number))

        def run(batches, shared=shared):
            yield from _search(*shared.value, min_lcs, fair_lcs, min_answer, min_words, far_lcs, complete)(batches)

        found = found.unionByName(d.mapInArrow(run, _PAIRS))
    best = F.max_by(F.struct("cosine", "lcs", "answer_found", "start_word"), F.struct(
        "lcs", "answer_found", "cosine", -F.col("start_word"))).alias("v")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "v.*")
