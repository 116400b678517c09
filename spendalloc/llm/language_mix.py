"""Language identification as a mixture of languages.

Each language is a distribution over hashed byte trigrams of lower-cased
letters, learned from labelled documents. Expectation-maximisation estimates the
shares of the languages in a text from its trigrams. The set of languages is
the one with the best penalised likelihood among the likeliest one, two, three
and so on: a further language must gain more than its penalty. The largest
share of that set is the prediction, and its share the score.

Learning takes at most about `train_docs` documents of each language, those with
the smallest hash of the id; every language that a label names is learned, and
more than `max_langs` of them are an error, since the model (128 KB for each) is
sent to all tasks. Prediction covers whole texts of all rows. Null texts, texts
without a letter, and all texts when nothing could be learned, are "und" with
score 0. Ties go to the language that comes first by name. Repeated rows each
get a row; an empty table gives an empty result; extra columns are ignored."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, cut, id_text, stash, table

BUCKETS = 1 << 14
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the text's letters, with one blank around words."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = (a[:-2] * np.uint32(65599 * 65599 % (1 << 32)) + a[1:-1] * np.uint32(65599) + a[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(18)).astype(np.int64)


def _learn(batches):
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
    sums: dict = {}

    def flush():
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield table(schema, lang=[lang] * len(at), bucket=at, n=n[at])
        sums.clear()

    for b in cut(batches):
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if has_letter(t):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(t), minlength=BUCKETS)
                if len(sums) >= 256:
                    yield from flush()
    yield from flush()


def fit(docs: DataFrame, train_docs: int, max_langs: int, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages by name and their trigram probabilities. `docs` has doc_id, text, lang."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    # A written table of one row per language: small enough to be broadcast by its real size.
    sizes = stash(known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    n_langs = sizes.count()
    if n_langs > max_langs:
        raise ValueError(f"{n_langs} languages are labelled, more than max_langs = {max_langs}")
    if not n_langs:
        return [], np.zeros((BUCKETS, 0))
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    counts = known.join(sizes, "lang").filter(place < train_docs / F.col("size")).select("lang", "text").mapInArrow(
        _learn, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.full((BUCKETS, len(langs)), smooth)
    n[counts["bucket"], counts["lang"].map({x: i for i, x in enumerate(langs)})] += counts["n"]
    return langs, n / n.sum(0)


def _mix(p, counts, starts, doc, total, use, rounds):
    """Shares of the languages in `use` (documents x languages) and the log-likelihood of each document."""
    share = use / use.sum(1, keepdims=True)
    for _ in range(rounds):
        part = p * share[doc]
        part *= (counts / np.maximum(part.sum(1), 1e-300))[:, None]
        share = np.add.reduceat(part, starts) / total[:, None]
    like = np.log(np.maximum((p * share[doc]).sum(1), 1e-300))
    return share, np.add.reduceat(counts * like, starts)


def infer(texts: list[str], probs: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Shares (documents x languages) of texts that have letters."""
    buckets, counts, starts = [], [], [0]
    for t in texts:
        n = np.bincount(trigrams(t), minlength=BUCKETS)
        at = np.flatnonzero(n)
        buckets.append(at)
        counts.append(n[at])
        starts.append(starts[-1] + len(at))
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    starts = np.array(starts[:-1])
    p, c = probs[np.concatenate(buckets)], np.concatenate(counts).astype(float)
    total = np.add.reduceat(c, starts)
    n_langs = probs.shape[1]
    alone = np.add.reduceat(np.log(p) * c[:, None], starts)
    best = np.eye(n_langs)[alone.argmax(1)]
    if n_langs == 1:
        return best
    value = alone.max(1)
    everything, _ = _mix(p, c, starts, doc, total, np.ones_like(alone), rounds)
    # The likeliest language alone leads; the others follow by their share in the full mixture.
    order = np.argsort(-(everything + 2 * best), 1, kind="stable")
    open_docs = np.arange(len(texts))
    for k in range(2, n_langs + 1):
        rows = np.isin(doc, open_docs)
        use = np.zeros((len(open_docs), n_langs))
        np.put_along_axis(use, order[open_docs, :k], 1.0, 1)
        sub = np.searchsorted(open_docs, doc[rows])
        first = np.searchsorted(sub, np.arange(len(open_docs)))
        share, like = _mix(p[rows], c[rows], first, sub, total[open_docs], use, rounds)
        like -= penalty * (k - 1) * np.log(np.maximum(total[open_docs], 2))
        better = like > value[open_docs]
        best[open_docs[better]], value[open_docs[better]] = share[better], like[better]
        open_docs = open_docs[better]
        if not len(open_docs):
            break
    return best


def language_mix(docs: DataFrame, train: Column | None = None, train_docs: int = 5000, max_langs: int = 1000,
                 rounds: int = 12, penalty: float = 3.0, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", keep_columns: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, mixture ("en:0.93 fr:0.07") for every row.

    `train` is the condition for rows to learn from; `penalty` is what a further
    language costs, in units of the logarithm of the number of trigrams. With
    `keep_columns` the rows of `docs` come back whole, with the three columns."""
    learn = docs if train is None else docs.filter(train)
    langs, probs = fit(learn.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                                    F.col(lang_col).cast("string").alias("lang")), train_docs, max_langs)
    # Documents whose trigram tables together stay small, however many languages there are.
    rows = max(1, min(200, 2000 // max(1, len(langs))))

    def of(texts):
        lettered = [i for i, t in enumerate(texts) if langs and has_letter(t)]
        pred, score, mixture = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
        if lettered:
            for i, s in zip(lettered, infer([texts[i] for i in lettered], probs, rounds, penalty)):
                top = int(s.argmax())
                pred[i], score[i] = langs[top], min(1.0, float(s[top]))
                mixture[i] = " ".join(f"{langs[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] > 0)
        return pred, score, mixture

    return append_columns(docs if keep_columns else id_text(docs, id_col, text_col), of,
                          "lang_pred string, score double, mixture string",
                          text_col if keep_columns else "text", rows=rows, size=1 << 20).select(
        *(docs.columns if keep_columns else ["doc_id"]), "lang_pred", "score", "mixture")
