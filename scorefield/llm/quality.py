"""Quality classifier: Bradley-Terry ranking of documents, cut at a quantile of the scores.

Each preference pair is a good and a bad labelled document; the chance that the good one wins is the logistic function of
the difference of their scores, and scores are linear in features of the text. The logistic loss over the pairs' feature
differences is minimised by Newton's method. Features are counts of the surface and hashed words and pairs of words. Among the quantiles of the labelled scores, the one that parts the labels
best becomes the threshold, and scores are shifted so that it lies at a fixed value.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, byte_class, chunks, labelled_sample, list_column, mix, read_table, span_hashes, words_of

#: Labelled rows to learn from at most, pairs for each of them, and pairs that Newton's method takes at once.
SAMPLE, PAIRS, BLOCK = 20_000, 4, 8192
#: log2 of the buckets of hashed n-grams; the penalties of the features of the surface and of the buckets.
BITS, RIDGE, HASHED_RIDGE = 8, 1e-2, 1e-1
#: What the threshold scores.
AT = 0.3

_upper, _lower, _digit = (~byte_class(s) for s in ((65, 90), (97, 122), (48, 57)))
_symbol = ~byte_class((33, 47), (58, 64), (91, 96), (123, 126)) & byte_class((44, 44), (46, 46), (39, 39), (45, 45))
NAMES = ["words", "word_bytes", "upper", "digits", "symbols", "ends_in_symbol", "lone_symbol", "capital_words", "repeated", "next_same", "repeated_pairs", "line_words", "repeated_lines"]


def features(column: pa.Array) -> np.ndarray:
    """A row for each text; an empty one has zeros."""
    words = words_of(column)
    n, many = len(words.first) - 1, words.count
    text, data = words.text_of(), words.data
    size = np.maximum(many, 1)
    of_byte = np.repeat(np.arange(n), np.diff(words.at))
    bytes_ = np.maximum(np.bincount(of_byte, minlength=n), 1)
    per_byte = lambda table: np.bincount(of_byte[table[data]], minlength=n) / bytes_
    per_word = lambda mask: np.bincount(text[mask], minlength=n) / size
    up = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_upper[data], out=up[1:])
    length = words.end - words.start
    h = words.hashes()

    def repeats(key, of):
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key), bool)
        same[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        return np.bincount(of[same], minlength=n)

    inside = np.flatnonzero(np.arange(len(h)) + 1 < words.last())
    both = mix(h[inside] * U(3) + h[inside + 1])
    line_end = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([words.at, line_end, line_end + 1]))
    lo, hi = bounds[:-1], bounds[1:]
    full = (hi > lo) & ~((hi - lo == 1) & (data[np.minimum(lo, max(len(data) - 1, 0))] == 10)) if len(data) else np.zeros(len(lo), bool)
    lo, hi = lo[full], hi[full]
    line_of = np.searchsorted(words.at, lo, "right") - 1
    lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    out = [
        np.log1p(many),
        np.bincount(text, weights=length, minlength=n) / size / 10,
        per_byte(_upper),
        per_byte(_digit),
        per_byte(_symbol),
        per_word((length > 1) & _symbol[data[words.end - 1]]) if len(h) else np.zeros(n),
        per_word((length == 1) & _symbol[data[words.start]]) if len(h) else np.zeros(n),
        per_word((up[words.end] - up[words.start] >= 2) & (up[words.end] - up[words.start] >= 0.5 * length)) if len(h) else np.zeros(n),
        repeats(mix(h ^ text.astype(U) * U(0x9E3779B97F4A7C15)), text) / size,
        per_word(np.append(h[1:] == h[:-1], False) & (np.arange(len(h)) + 1 < words.last())) if len(h) else np.zeros(n),
        repeats(mix(both ^ text[inside].astype(U) * U(0x9E3779B97F4A7C15)), text[inside]) / size,
        np.log1p(many / lines),
        repeats(mix(span_hashes(data, lo, hi) ^ line_of.astype(U) * U(0x9E3779B97F4A7C15)), line_of) / lines if len(lo) else np.zeros(n),
    ]
    return np.stack(out, axis=1)


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hashed bucket of each word and pair of neighbours, and for each text one over their number."""
    words = words_of(column)
    h, text = words.hashes(), words.text_of()
    inside = np.flatnonzero(np.arange(len(h)) + 1 < words.last())
    both = np.concatenate([mix(h ^ U(1)), mix(h[inside] * U(3) + h[inside + 1])])
    of = np.concatenate([text, text[inside]])
    return of, (both >> U(64 - BITS)).astype(np.int64), 1 / np.maximum(np.bincount(of, minlength=len(words.first) - 1), 1)


def rows_of(column: pa.Array) -> np.ndarray:
    """All features of each text: those of its surface, then the share of its n-grams in each bucket."""
    of, bucket, part = ngrams(column)
    share = np.bincount(of << BITS | bucket, minlength=len(part) << BITS).reshape(len(part), -1) * part[:, None]
    return np.concatenate([features(column), share], axis=1)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, float]:
    """Weights that minimise the logistic loss of the differences of good and bad rows, and the threshold."""
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):  # nothing to prefer: keep all, or reject all
        return np.zeros(x.shape[1]), -1.0 if not len(bad) else 1.0
    random = np.random.default_rng(7)
    many = pairs * len(y)
    a, b = random.choice(good, many), random.choice(bad, many)
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = x / scale
    w = np.zeros(x.shape[1])
    ridge = np.where(np.arange(len(w)) < len(NAMES), RIDGE, HASHED_RIDGE)
    for _ in range(25):
        gradient, hessian = ridge * w, np.diag(ridge)
        for lo in range(0, many, BLOCK):
            d = z[a[lo : lo + BLOCK]] - z[b[lo : lo + BLOCK]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
            gradient += d.T @ (p - 1) / many
            hessian += (d * (p * (1 - p))[:, None]).T @ d / many
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w /= scale
    s = x @ w
    cuts = np.quantile(s, np.linspace(0, 1, 2001))
    wrong = np.searchsorted(np.sort(s[good]), cuts, "left") / len(good) + 1 - np.searchsorted(np.sort(s[bad]), cuts, "left") / len(bad)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    at = (cuts[best[0]] + cuts[best[-1]]) / 2
    below, above = s[s < at], s[s >= at]
    if len(below) and len(above):  # in the middle of the gap that the quantile falls into
        at = (below.max() + above.min()) / 2
    return w, float(at)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights of the features and the threshold, from labelled rows (doc_id, quality).

    Null labels and doc_ids and labels without a document are left out; repeated rows count once (see labelled_sample); null
    and empty texts have features of zero. At most so many rows are learned from, in the order of a hash of doc_id, so ties
    and reruns agree. Labels of one kind keep, or reject, all; no labels keep all. Other columns are ignored.
    """
    picked = labelled_sample(documents, labels, "quality", sample)
    many = len(NAMES) + (1 << BITS)

    def scan(batches):
        for part in chunks(batches):
            x = rows_of(part.column(1))
            at = np.arange(part.num_rows + 1) * many
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.ravel()))], ["doc_id", "quality", "x"])

    def learn(batches):
        held = [(batch.column(1).to_numpy(), list_column(batch.column(2))[1].to_numpy(zero_copy_only=False)) for batch in batches if batch.num_rows]
        x = np.concatenate([x for _, x in held] or [np.zeros(0)]).reshape(-1, many)
        w, at = fit(x, np.concatenate([y for y, _ in held] or [np.zeros(0)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(many), -1)), pa.array(np.append(w, at))], ["i", "w"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = picked.mapInArrow(scan, f"doc_id {kind}, quality int, x array<double>")
    # one task learns from the bounded sample, in an order that depends on the rows alone
    model = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(learn, "i long, w double").collect()
    held = dict(model)
    return np.array([held.get(i, 0.0) for i in range(many)]), held.get(-1, -1.0)


def _scores(column: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    w, at = model
    of, bucket, part = ngrams(column)
    shares = np.bincount(of, weights=w[len(NAMES) :][bucket], minlength=len(part)) * part
    s = features(column) @ w[: len(NAMES)] + shares - at + np.log(AT / (1 - AT))
    return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and score (0 to 1) per row of documents, repeated rows and null doc_ids included.

    Equal texts score equal; null and empty texts have features of zero; texts of any length are taken whole. An empty table
    gives no rows. Other columns are ignored."""

    def scan(batches):
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(_scores(part.column(1), model))], ["doc_id", "text_hash", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(scan, f"doc_id {kind}, text_hash long, score double")


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0


def drop_low_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at or above the threshold, repeated rows and null doc_ids included; columns as they are.
    Null and empty texts are judged by features of zero. Empty documents give no rows; without labels all stay."""
    model = train(documents, labels)

    def scan(batches):
        for part in chunks(batches):
            keep = _scores(part.column(part.schema.get_field_index("text")), model) >= AT
            if keep.any():
                yield part.filter(pa.array(keep))

    return documents.mapInArrow(scan, documents.schema)


def op6_quality_classifier(spark, sf_dir):
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(documents, labels.select("doc_id", "quality").where(~held_out()))
    return score(documents, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))
