"""Toxicity: logistic regression by follow-the-regularised-leader (FTRL-proximal) over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and an L1 term keeps the weights of features that don't matter at zero, so the
model is a short list of (index, weight) that every task can hold. Labels are learned from a bounded sample of the
labelled rows, one document after the other, in one task; all documents are then scored in their partitions.

Features are the presence of: words, pairs of neighbours, pairs with one word between, and the first four and five bytes
of words (word n-grams of stems, which carry over to inflected forms).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASES, LETTERS, U, chunks, labelled_sample, list_column, materialize, mix, read_table, span_hashes, words_of

#: log2 of the number of hashed features, and labelled rows and features of all of them to learn from at most.
BITS, SAMPLE, FEATURES, EPOCHS = 20, 12_000, 100_000_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
#: What a document on the border of the labelled sample scores.
AT = 0.7
STEMS = (4, 5)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed feature of each n-gram, skip-gram and stem of the texts; repeats are not removed."""
    words = words_of(column, LETTERS, True)
    h, text, last = words.hashes(), words.text_of(), words.last()
    at = np.arange(len(h))
    out, of = [mix(h ^ U(1))], [text]
    for gap, salt in ((1, 2), (2, 3)):
        i = np.flatnonzero(at + gap < last)
        out.append(mix(h[i] * U(BASES[0]) + h[i + gap] * U(BASES[1]) + U(salt)))
        of.append(text[i])
    for n in STEMS:
        i = np.flatnonzero(words.end - words.start > n)
        out.append(mix(span_hashes(words.data, words.start[i], words.start[i] + n) ^ U(3 + n)))
        of.append(text[i])
    return np.concatenate(of), (np.concatenate(out) >> U(64 - BITS)).astype(np.int64)


def learn(examples, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and weights that are not zero, and the bias, from (features, label) in a fixed order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(z[i]) <= L1] = 0
        w[i == bias] = -z[bias] / ((BETA + np.sqrt(n[bias])) / ALPHA)
        return w

    for _ in range(epochs):
        for x, y in examples:
            i = np.append(x, bias)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            rate = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - rate * w
            n[i] += g * g
    every = np.arange((1 << BITS) + 1)
    w = weights(every)
    kept = np.flatnonzero(w[:-1])
    return kept, w[kept], float(w[-1])


def border(margins: np.ndarray, labels: np.ndarray) -> float:
    """Where the labelled margins part best: in the middle of the widest run of equally good cuts."""
    if not 0 < labels.sum() < len(labels):
        return 0.0
    m, y = margins[order := np.argsort(margins, kind="stable")], labels[order]
    wrong = np.append(0, np.cumsum(y > 0)) + np.append(np.cumsum((y <= 0)[::-1])[::-1], 0)
    i = int(np.flatnonzero(wrong == wrong.min())[0])
    return float((m[max(i - 1, 0)] + m[min(i, len(m) - 1)]) / 2)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, features_most: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from labelled rows (doc_id, toxic): indices, weights and bias.

    Null labels and doc_ids and labels without a document are left out. Repeated rows count once (see labelled_sample), null
    and empty texts teach the bias alone. At most so many rows are learned from, until there are so many features, in the order of a hash of
    doc_id, so ties and reruns agree. No labels, or empty tables, give a model without weights. Other columns are ignored.
    """
    picked = labelled_sample(documents, labels, "toxic", sample)

    def featurise(batches):
        for part in chunks(batches):
            text, feature = features(part.column(1))
            both = np.unique(text << BITS | feature)
            text, feature = both >> BITS, both & ((1 << BITS) - 1)
            at = np.searchsorted(text, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(feature.astype(np.int32)))], ["doc_id", "toxic", "x"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    order = F.xxhash64("doc_id")
    rows = materialize(picked.select("doc_id", "text", "toxic").mapInArrow(featurise, f"doc_id {kind}, toxic int, x array<int>"), "toxicity-sample")
    so_far = F.sum(F.size("x").cast("long")).over(Window.orderBy(order, "doc_id"))  # over the ids and sizes of the sample only
    fitting = rows.select("doc_id", (so_far - F.size("x")).alias("before")).where(F.col("before") < features_most).select("doc_id")
    rows = rows.join(F.broadcast(fitting), "doc_id", "left_semi")

    def fit(batches):
        examples = []
        for batch in batches:
            at, x = list_column(batch.column(2))
            x = x.to_numpy(zero_copy_only=False)
            examples += [(x[at[i] : at[i + 1]].copy(), float(y)) for i, y in enumerate(batch.column(1).to_pylist())]
        index, w, bias = learn(examples)
        table = np.zeros(1 << BITS)
        table[index] = w
        cut = border(np.array([table[x].sum() + bias for x, _ in examples]), np.array([y for _, y in examples]))
        bias += np.log(AT / (1 - AT)) - cut
        yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1)), pa.array(np.append(w, bias))], ["i", "w"])

    # one task learns from the bounded sample, in an order that depends on the rows alone
    model = rows.repartition(1).sortWithinPartitions(order, "doc_id").mapInArrow(fit, "i long, w double").collect()
    index, w = np.array([r[0] for r in model], np.int64), np.array([r[1] for r in model])
    return index[:-1], w[:-1], float(w[-1]) if len(w) else 0.0


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) per row of documents, repeated rows and null doc_ids included; equal texts score equal, null and
    empty ones by the bias alone, and texts of any length are taken whole. An empty table gives no rows. Other columns are
    ignored."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        index, w, bias = held.value
        table = np.zeros(1 << BITS, np.float32)
        table[index] = w
        for part in chunks(batches):
            text, feature = features(part.column(1))
            some = np.flatnonzero(table[feature])
            both = np.unique(text[some] << BITS | feature[some])
            total = np.bincount(both >> BITS, weights=table[both & ((1 << BITS) - 1)], minlength=part.num_rows) + bias
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double")


def op1_toxicity(spark, sf_dir):
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = train(documents, labels.select("doc_id", "toxic").where(~held_out))
    return score(documents, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))
