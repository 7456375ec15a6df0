"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, learned from document labels.

A document is toxic if any of its sentences is: p(doc) = 1 - prod(1 - p(sentence)), and p(sentence)
is a logistic function of the words it holds and of their first 4 and 5 bytes, so that inflected
forms of a stem count together. Only documents carry labels; the gradient of the
noisy-or tells each sentence its share. The same sentence scores then locate the worst sentence.

The model is fitted on at most `max_train` labelled documents of at most `max_bytes` of text in all,
those with the smallest hash of doc_id, and only where crc32(doc_id) mod 4 is not 2. Everything else is
scored, whole texts, by a table of feature weights that is bounded by that sample.

Defined cases: null and empty texts, and texts without words, score 0 and are not predicted toxic.
A document with several labels is toxic if one says so; null labels teach nothing, and of rows repeated
under one labelled doc_id the text that is least in order teaches. Without any label of one kind every
document scores 0. Of sentences that score alike the first is the worst. Very long texts are scored
whole, by ranges of rows. Repeated rows are scored each. An empty table gives an empty result. Extra
columns are ignored by the score and kept by the filter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PUNCT, map_arrow, slices, utf8, words

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


PREFIXES = (4, 5)
SLOT_BITS = 18


@dataclass
class Model:
    """Feature hashes in ascending order, their weights, and the bias of a sentence; a few MB at any corpus size."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    taken: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, weights: np.ndarray, bias: float) -> Model:
        order = np.argsort(hashes)
        return Model(hashes[order], weights[order], bias, _taken(hashes))

    def weigh(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        where, at = _find(self.keys, self.taken, h)
        out[where] = self.weights[at]
        return out


def _taken(keys: np.ndarray) -> np.ndarray:
    """Which of 2^SLOT_BITS slots hold a key at all."""
    taken = np.zeros(1 << SLOT_BITS, bool)
    taken[keys >> np.uint64(64 - SLOT_BITS)] = True
    return taken


def _find(keys: np.ndarray, taken: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h that hold a key, and which one; the slots only spare the search of most others."""
    where = np.flatnonzero(taken[h >> np.uint64(64 - SLOT_BITS)])
    at = np.searchsorted(keys, h[where])
    hit = keys[np.minimum(at, len(keys) - 1)] == h[where] if len(keys) else np.zeros(len(where), bool)
    return where[hit], at[hit]


def _untaught() -> Model:
    return Model.of(np.zeros(0, np.uint64), np.zeros(0), -30.0)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """Words, and for each sentence its first word and its row; words stay in order."""
    w = words(data, offsets, True, PUNCT)
    marks = np.cumsum(_BREAK[data])
    row = np.searchsorted(offsets, w.start, "right") - 1
    key = marks[w.start] if len(w.start) else np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return w, first, row[first]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _excess(df: np.ndarray, toxic_df: np.ndarray, share: float) -> np.ndarray:
    """Standard deviations by which toxic documents exceed their share among the documents that hold a feature."""
    return (toxic_df - df * share) / np.sqrt(np.maximum(df, 1) * share * (1 - share))


def _gradient(theta: np.ndarray, bias: float, index: np.ndarray, sents: np.ndarray, doc: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Gradient, by weights and then bias, of the mean negative log likelihood of the documents' labels, with a ridge on the weights.

    `index` and `sents` name the feature and sentence of each occurrence, `doc` the document of each sentence.
    """
    p = _sigmoid(bias + np.bincount(sents, theta[index], len(doc)))
    none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))  # the chance that no sentence is toxic
    factor = np.where(y > 0, -none / np.maximum(1 - none, 1e-6), 1.0)
    g = factor[doc] * p
    return np.append(np.bincount(index, g[sents], len(theta)) + ridge * theta, g.sum()) / len(y)


def fit(texts: pa.Array, toxic: np.ndarray, min_docs: int = 4, epochs: int = 150, ridge: float = 0.1, min_z: float = 4.0) -> Model:
    """Fits feature weights by full-batch Adam on the noisy-or likelihood."""
    data, offsets = utf8(texts)
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return _untaught()

    def parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """Per range of rows: first row, rows of its sentences, and hash and sentence of each feature."""
        for i, j in slices(offsets):
            w, first, row = sentences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w.hash))))
            yield row + i, [(h, of) for h in (w.hash, *(w.prefixes(k) for k in PREFIXES))]

    # z can reach min_z only with so many toxic documents, so that their features alone are listed; these
    # are counted over all documents, and only the features of promising counts are gathered
    share = y.mean()
    pairs = [np.zeros(0, np.uint64)]
    for row, found in parts(*utf8(texts.filter(pa.array(y > 0)))):
        h, of = np.concatenate([h for h, _ in found]), np.concatenate([row[of] for _, of in found])
        order = np.lexsort((of, h))
        h, of = h[order], of[order]
        pairs.append(h[np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]])
    listed, toxic_df = np.unique(np.concatenate(pairs), return_counts=True)
    able = toxic_df * (1 - share) >= min_z**2 * share * (1 - 1e-9)
    listed, toxic_df = listed[able], toxic_df[able]
    taken, df = _taken(listed), np.zeros(len(listed), np.int64)
    size = max(1, len(listed))
    for row, found in parts(data, offsets):
        got = []
        for h, of in found:
            where, at = _find(listed, taken, h)
            got.append(row[of[where]] * np.int64(size) + at)
        df += np.bincount(np.unique(np.concatenate(got)) % size, minlength=len(listed))[: len(listed)]
    chosen = listed[(_excess(df, toxic_df, share) >= min_z) & (df >= min_docs)]
    taken = _taken(chosen)
    feats, sents, doc, n_sent = [], [], [], 0
    for row, found in parts(data, offsets):
        for h, of in found:
            where, _ = _find(chosen, taken, h)
            feats.append(h[where])
            sents.append(of[where] + n_sent)
        doc.append(row)
        n_sent += len(row)
    feats, sents, doc = np.concatenate(feats), np.concatenate(sents), np.concatenate(doc)
    if not n_sent:
        return _untaught()
    vocab, index = np.unique(feats, return_inverse=True)
    # a feature takes part if toxic documents hold it clearly more often than their share of all documents
    seen = np.unique(doc[sents] * np.int64(max(1, len(vocab))) + index)
    which, where = seen % max(1, len(vocab)), seen // max(1, len(vocab))
    df = np.bincount(which, minlength=len(vocab))
    z = _excess(df, np.bincount(which, y[where], len(vocab)), share)
    keep = (df >= min_docs) & (z >= min_z)
    used = keep[index]
    index, sents = (np.cumsum(keep) - 1)[index[used]], sents[used]
    n = int(keep.sum())
    theta, bias = np.zeros(n), -6.0
    m1, m2 = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, epochs + 1):
        grad = _gradient(theta, bias, index, sents, doc, y, ridge)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        theta -= move[:-1]
        bias -= move[-1]
    return Model.of(vocab[keep], theta, float(bias))


def sentence_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple:
    """Words, first word and row of each sentence, and its score."""
    w, first, row = sentences(data, offsets)
    z = np.full(len(first), model.bias)
    if len(first):
        each = model.weigh(w.hash)
        for k in PREFIXES:
            each += model.weigh(w.prefixes(k))
        z += np.add.reduceat(each, first)
    return w, first, row, _sigmoid(z)


def held_out(doc_id: Column) -> Column:
    """Documents that never teach: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def teaching_rows(docs: DataFrame, labels: DataFrame, max_train: int = 8_000, max_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, label and text of at most `max_train` labelled documents, not held out, with `max_bytes` of text in all; one partition."""
    marks = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_tx_id"))
        .agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("_tx_id"), "_tx_id")
        .limit(max_train)
    )
    one = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks), F.col("doc_id") == F.col("_tx_id"))
    one = one.groupBy("_tx_id", "label").agg(F.min("text").alias("text"))
    # at most max_train rows
    upto = Window.orderBy(F.xxhash64("_tx_id"), "_tx_id").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("upto", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(upto)).where(F.col("upto") <= max_bytes)
    return one.select(F.col("_tx_id").cast("bigint").alias("doc_id"), F.col("label").cast("double").alias("label"), "text")


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("text", pa.string())])).sort_by("doc_id").combine_chunks()
    if len(got):
        m = fit(got["text"].combine_chunks(), got["label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([m.keys.tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias])], ["keys", "weights", "bias"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8_000, max_bytes: int = 64 << 20) -> Model:
    """The model of the teaching rows. One task fits it, and only features and weights come to the driver."""
    rows = map_arrow(teaching_rows(docs, labels, max_train, max_bytes), _teach, "keys binary, weights binary, bias double").collect()
    if not rows:
        return _untaught()
    return Model.of(np.frombuffer(rows[0]["keys"], np.uint64), np.frombuffer(rows[0]["weights"], np.float64), rows[0]["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the byte range and score of the worst sentence, for every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            n = batch.num_rows
            total, worst, begin, end = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, j in slices(off):
                w, first, row, p = sentence_scores(model, data[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(first):
                    continue
                total[i:j] = -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), j - i))
                last = np.append(first[1:], len(w.start)) - 1
                best = np.lexsort((-np.arange(len(p)), p, row))  # the highest score, then the first sentence, comes last in a row
                best = best[np.append(row[best][1:] != row[best][:-1], True)]
                at = row[best] + i
                base = off[i] - off[at]
                worst[at], begin[at], end[at] = p[best], w.start[first[best]] + base, w.end[last[best]] + base
            columns = [batch.column(0), pa.array(np.clip(total, 0.0, 1.0)), pa.array(worst), pa.array(begin), pa.array(end)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "worst_score", "worst_start", "worst_end"])

    schema = "doc_id bigint, score double, worst_score double, worst_start bigint, worst_end bigint"
    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), rows, schema)


def judge(docs: DataFrame, labels: DataFrame, max_train: int = 8_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence of every document."""
    scored = score(docs, train(docs, labels, max_train))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = 8_000, threshold: float = 0.3) -> DataFrame:
    """The documents whose score stays below `threshold`, with all their columns, in one pass over the rows."""
    model = train(docs, labels, max_train)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(batch.schema.get_field_index("text")))
            total = np.zeros(batch.num_rows)
            for i, j in slices(off):
                _, _, row, p = sentence_scores(model, data[off[i] : off[j]], off[i : j + 1] - off[i])
                total[i:j] = -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), j - i)) if len(row) else 0.0
            yield batch.filter(pa.array(total < threshold))

    return map_arrow(docs, keep, docs.schema)
