"""Quality rules with a linear-chain conditional random field over lines.

Each line has features (length, shares of kinds of characters, repeats); the
field's weights and transitions are learned from documents that carry a quality
label. Their lines take the document's label, so none of them shows a change;
further chains therefore join a run of a good document and one to four lines of
a poor one, before or after it, as headers and footers stand. Viterbi decoding marks
each line of a text content or boilerplate, and a document is kept when enough
of its characters stand in content lines. Base rules come first.

The field is fitted on a bounded sample: `train_docs` labelled documents, those
with the smallest hash of the id, of each a run of `train_lines` lines that
begins anywhere in the text (by the text's hash), and at most `MIXED` joined chains.
Rows that share an id are taken by the hash of their texts, so that the sample
does not depend on partitions. Everything else covers whole texts of all rows. Null and empty texts have no
words and fail the base rules. Repeated rows each get a row; with no labelled
document every line is content; an empty table gives an empty result; extra
columns are ignored."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, table

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_KINDS = [SYMBOLS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"!?", b"|", b"/@_=+{}[]\\~^",
          b".,;:", bytes(range(128, 256))]
N_FEATURES = len(_KINDS) + 8
MIXED = 1000
_MARK = [np.isin(np.arange(256), list(k)) for k in _KINDS]


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line of a UTF-8 text, and the lines' lengths in bytes."""
    data = np.frombuffer(raw + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    x = np.zeros((len(ends), N_FEATURES))
    long = np.maximum(size, 1)
    for j, mark in enumerate(_MARK):
        x[:, j] = np.minimum(np.add.reduceat(mark[data], starts) / long * 4, 4)
    lines = raw.split(b"\n")
    seen, again = set(), np.zeros(len(lines))
    for i, line in enumerate(lines):
        again[i] = line in seen
        seen.add(line)
    k = len(_KINDS)
    x[:, k] = 1
    x[:, k + 1] = np.minimum(size / 200, 2)
    x[:, k + 2] = size < 30
    x[:, k + 3] = size == 0
    x[:, k + 4] = again
    x[:, k + 5] = np.isin(data[np.maximum(ends - 1, starts)], [33, 46, 63, 34, 41])
    spaces = np.add.reduceat(data == 32, starts)
    x[:, k + 6] = np.minimum(size / (spaces + 1) / 10, 3)
    x[:, k + 7] = np.isin(data[starts], _KINDS[1])
    return x, size


def train_field(docs: list, labels: list, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-3):
    """Weights (features x 2) and transitions (2 x 2) that maximise the conditional likelihood of the labels."""
    w, trans = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if not docs:
        w[:, 1] = 0
        w[len(_KINDS), 1] = 1.0  # nothing known: all is content
        return w, trans
    longest = max(map(len, docs))
    x = np.zeros((len(docs), longest, N_FEATURES))
    mask = np.zeros((len(docs), longest), bool)
    y = np.zeros((len(docs), longest), int)
    for i, (d, label) in enumerate(zip(docs, labels)):
        x[i, :len(d)], mask[i, :len(d)], y[i, :len(d)] = d, True, label
    n = mask.sum()
    want = np.eye(2)[y] * mask[:, :, None]
    pair = mask[:, 1:] & mask[:, :-1]
    want_t = np.array([[(pair & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    velocity = [np.zeros_like(w), np.zeros_like(trans)]
    for _ in range(rounds):
        e = (x @ w) * mask[:, :, None]
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(ahead[:, t - 1, :1] + trans[0], ahead[:, t - 1, 1:] + trans[1]) + e[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = e[:, t + 1] + back[:, t + 1]
            step = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
            back[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        prob = np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + trans + (e + back)[:, 1:, None, :] - total[:, None, None, None])
        grads = (np.einsum("dtf,dts->fs", x, want - prob) / n - ridge * w,
                 (want_t - (both * pair[:, :, None, None]).sum((0, 1))) / n - ridge * trans)
        for v, g, p in zip(velocity, grads, (w, trans)):
            v *= 0.9
            v += rate * g
            p += v
    return w, trans


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best labels of a chain of lines (0 boilerplate, 1 content); ties go to content."""
    (t00, t01), (t10, t11) = trans.tolist()
    rows = emit.tolist()
    a, b = rows[0]
    steps = []
    for e0, e1 in rows[1:]:
        from0, from1 = b + t10 >= a + t00, b + t11 >= a + t01
        steps.append((from0, from1))
        a, b = (b + t10 if from0 else a + t00) + e0, (b + t11 if from1 else a + t01) + e1
    state = int(b >= a)
    out = [state]
    for step in reversed(steps):
        state = int(step[state])
        out.append(state)
    return out[::-1]


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of `width` words (a power of two) that occur twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == n:
        return 0
    span = 1
    while span < width:
        # Windows of twice the span are numbered by the numbers of their halves: no hash, no collision.
        _, code = np.unique(code[:-span] * (code.max() + 1) + code[span:], return_inverse=True)
        span *= 2
    again = np.bincount(code)[code] > 1
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def base_figures(raw: bytes, n_points: int):
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    return (len(words), n_points - spaces, symbols, len(lines) - len(set(lines)), repeat_words(words))


def _train_rows(max_lines):
    schema = pa.schema([("id", pa.int64()), ("quality", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()),
                        ("x", pa.list_(pa.float64()))])

    def run(batches):
        for b in cut(batches):
            rows, digests = [], []
            for t in b.column("text").to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                digests.append(xxhash.xxh3_64_intdigest(raw) >> 1)
                x, _ = line_features(raw)
                start = digests[-1] % max(1, len(x) - max_lines + 1)
                rows.append(x[start:start + max_lines])
            yield table(schema, id=b.column("_id"), quality=b.column("quality"), digest=digests,
                        n=[len(r) for r in rows], x=[r.ravel().tolist() for r in rows])
    return run


def mixed_chains(good: list, poor: list, most: int = MIXED) -> tuple[list, list]:
    """Chains of a run of a good document next to one to four lines of a poor one, and their labels."""
    docs, labels = [], []
    for i in range(min(most, max(len(good), len(poor)))) if good and poor else ():
        a, p = good[i % len(good)], poor[i % len(poor)]
        n = 1 + i // 2 % 4
        start = 7 * i % max(1, len(p) - n + 1)
        b = p[start:start + n]
        parts = [(a, 1), (b, 0)] if i % 2 == 0 else [(b, 0), (a, 1)]
        docs.append(np.concatenate([x for x, _ in parts]))
        labels.append(np.concatenate([np.full(len(x), y) for x, y in parts]))
    return docs, labels


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 2000, train_lines: int = 60):
    """Field fitted on a bounded sample of labelled documents; what reaches the driver has that bound."""
    sample = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("long").alias("quality")).orderBy(
        F.xxhash64("_id"), "_id", "quality").limit(train_docs)
    rows = docs.join(sample, F.col("doc_id") == F.col("_id")).select("_id", "quality", "text").mapInArrow(
        _train_rows(train_lines), "id long, quality long, digest long, n long, x array<double>").orderBy(
        F.xxhash64("id"), "id", "quality", "digest").limit(2 * train_docs).collect()
    docs_x = [np.array(r["x"]).reshape(r["n"], N_FEATURES) for r in rows]
    good = [x for x, r in zip(docs_x, rows) if r["quality"] > 0]
    poor = [x for x, r in zip(docs_x, rows) if r["quality"] <= 0]
    mixed, changes = mixed_chains(good, poor)
    return train_field(docs_x + mixed, [np.full(r["n"], int(r["quality"] > 0)) for r in rows] + changes)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
                     ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                     ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])


def quality_rules(docs: DataFrame, labels: DataFrame, min_share: float = 0.5, train_docs: int = 2000,
                  train_lines: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base figures, base_failed, kept, content_share for every row."""
    d = id_text(docs, id_col, text_col)
    w, trans = fit(d, labels, train_docs, train_lines)

    def run(batches):
        for b in cut(batches):
            rows = []
            for t in b.column("text").to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                base = base_figures(raw, len(t))
                failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
                x, size = line_features(raw)
                state = np.array(viterbi(x @ w, trans))
                share = float(size @ state / size.sum()) if size.sum() else 0.0
                rows.append((*base, failed, not failed and share >= min_share, share))
            yield table(_SCHEMA, doc_id=b.column("doc_id"),
                        **{f.name: list(c) for f, c in zip(list(_SCHEMA)[1:], zip(*rows))})

    return d.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                             "n_repeat_words long, base_failed boolean, kept boolean, content_share double")
