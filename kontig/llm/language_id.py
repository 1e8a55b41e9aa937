"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are taken inside words (lower-case letters, a mark at both ends of a word) and
hashed into BUCKETS. A bucket's document frequency covers every labelled text; its value in a text is its share
of the text's n-grams times its inverse document frequency. The weights are fitted by follow-the-regularised-leader with
per-coordinate rates, whose L1 part makes them sparse and whose L2 part keeps them small (McMahan et al., 2013), on a bounded sample. A fold that
the weights had not seen sets one temperature, so that scores are probabilities.

As the values are shares, a text's logits are sums over its n-grams of one table of numbers; long texts are summed up in pieces.

Edge cases: null texts and texts without a letter give ``und`` with score 0; rows with a null label are not learnt
from; a single label gives score 1; without any labelled text all is ``und``; repeated rows get equal results; an empty table
gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontig.llm.common import drop_clashes, text_slices

BUCKETS, LONGEST = 1 << 16, 3
#: Texts of the fitted sample, shared equally by the labels, and how often it is gone through.
SAMPLE_TEXTS, EPOCHS = 6_000, 2
#: Learning rate, its offset, L1 and L2 penalties; every FOLD-th text of the sample sets the temperature.
ALPHA, BETA, L1, L2, FOLD = 0.3, 1.0, 0.02, 0.001, 5
#: Characters of a text, and of texts together, that are worked on at once.
PIECE_CHARS, GROUP_CHARS = 1 << 18, 1 << 18
#: The shares are so small that rates would be too; all values are multiplied by this.
SCALE = 100.0
UNKNOWN = "und"


@functools.cache
def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, bucket) of the n-grams of code points in which 0 stands for what is no letter.

    An n-gram lies inside one word with its marks: it may begin or end with a 0, but holds a letter and no inner 0.
    """
    letter = chars > 0
    begins, buckets = [], []
    for n in range(1, LONGEST + 1):
        m = len(chars) - n + 1
        if m < 1:
            break
        whole = letter if n == 1 else letter[:m] | letter[1:] if n == 2 else np.ones(m, bool)
        for i in range(1, n - 1):
            whole = whole & letter[i : i + m]
        at = np.flatnonzero(whole)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ chars[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        begins.append(at)
        buckets.append((h >> np.uint64(13)).astype(np.int64) % BUCKETS)
    return np.concatenate(begins or [np.empty(0, np.int64)]), np.concatenate(buckets or [np.empty(0, np.int64)])


def _chars(text: str) -> np.ndarray:
    """Code points of the text's lower-case letters, 0 for everything else and at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.where(_is_letter()[points], points, 0), [0]]).astype(np.uint32)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all n-grams, group by group of about GROUP_CHARS; a longer text comes in several."""
    held, size = [], 0

    def flush():
        flat = np.concatenate([c for _, c in held])
        begin, bucket = _grams(flat)
        ends = np.cumsum([len(c) for _, c in held])
        return np.array([i for i, _ in held])[np.searchsorted(ends, begin, "right")], bucket

    for i, text in enumerate(texts):
        chars = _chars(text or "")
        for at in range(0, max(1, len(chars) - LONGEST + 1), PIECE_CHARS):
            # a piece has the n-grams that begin in it, and lends the next one's first characters
            part = chars[at : at + PIECE_CHARS + LONGEST - 1]
            if len(chars) > PIECE_CHARS + LONGEST - 1:
                begin, bucket = _grams(part)
                mine = begin < PIECE_CHARS if at + PIECE_CHARS < len(chars) - LONGEST + 1 else begin >= 0
                yield np.full(int(mine.sum()), i), bucket[mine]
            else:
                held.append((i, part))
                size += len(part)
        if size >= GROUP_CHARS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and how many of its n-grams each has."""
    counts = np.zeros(BUCKETS, np.int64)
    for _, bucket in pieces([text]):
        counts += np.bincount(bucket, minlength=BUCKETS)
    held = np.flatnonzero(counts)
    return held, counts[held]


def document_frequencies(texts: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all of them, and their number. One row a bucket and task is shuffled."""

    def run(batches):
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for part in (p for batch in batches for p in text_slices(batch, 0)):
            texts = part.column(0).to_pylist()
            n += len(texts)
            last = np.empty(0, np.int64)  # of the text that the last group ended with
            for where, bucket in pieces(texts):
                pairs = np.unique(where * BUCKETS + bucket)
                fresh = pairs[~np.isin(pairs, last)]
                counts += np.bincount(fresh % BUCKETS, minlength=BUCKETS)
                if len(pairs):
                    end = pairs[-1] // BUCKETS
                    last = np.union1d(last[last // BUCKETS == end], pairs[pairs // BUCKETS == end])
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(counts[held], n))], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    n = 0
    for row in texts.select(F.col(f"`{text_col}`")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row a bucket
        if row.bucket < 0:
            n = row.n
        else:
            out[row.bucket] = row.n
    return out, n


@dataclass
class Model:
    """Logits of a text are ``bias`` + the sums of ``table`` over its n-grams / their number, over the temperature."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated logits of each text, and its number of n-grams (0 without a letter)."""
        sums, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), np.int64)
        for where, bucket in pieces(texts):
            n += np.bincount(where, minlength=len(texts))
            for k in range(len(self.labels)):
                sums[:, k] += np.bincount(where, self.table[bucket, k], len(texts))
        return self.bias + sums / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and calibrated probability of each text."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, n = self.logits(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(1)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, p.max(1), 0.0)


EMPTY = Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader: sums of gradients ``z`` and of their squares ``n``, the weights follow from both."""

    def __init__(self, size: int, labels: int) -> None:
        self.z, self.n = np.zeros((size, labels)), np.zeros((size, labels))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = _softmax(x @ w)
        slope[label] -= 1
        g = x[:, None] * slope
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature between 0.05 and 20 under which the labels are likeliest, by golden sections of its logarithm.

    The likelihood has one peak. Two pseudo-texts that are wrong keep a fold without an error from sharpening without end.
    """
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(label)), label], 1e-300)).sum() - 2 * np.log(np.maximum(1 - p.max(1), 1e-300)).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(samples: list[tuple[str, list[int], list[int]]], frequency: np.ndarray, texts: int) -> Model:
    """The model of sample texts, each with its label, buckets and their counts. The last place of the leader is the bias."""
    labels = sorted({s[0] for s in samples})
    if not labels:
        return EMPTY
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    order = np.random.default_rng(0).permutation(len(samples))
    rows = []
    for i in order:
        label, at, count = samples[i]
        at, count = np.array(at, np.int64), np.array(count, float)
        rows.append((np.append(at, BUCKETS), np.append(SCALE * idf[at] * count / max(count.sum(), 1), 1.0), labels.index(label)))
    aside = rows[::FOLD] if len(rows) >= 10 * FOLD else []
    leader = Leader(BUCKETS + 1, len(labels))
    for _ in range(EPOCHS):
        for k, (at, x, label) in enumerate(rows):
            if not aside or k % FOLD:
                leader.learn(at, x, label)
    logits = np.array([x @ leader.weights(at) for at, x, _ in aside]).reshape(len(aside), len(labels))
    w = leader.weights(slice(None))
    return Model(labels, SCALE * idf[:, None] * w[:-1], w[-1], _temperature(logits, np.array([r[2] for r in aside], int)))


def training_sample(docs: DataFrame, key: str, label: str, text_col: str) -> DataFrame:
    """(label, text): at most SAMPLE_TEXTS texts, one of a key, by the least hashes of the keys and as many of each label.

    No more than SAMPLE_TEXTS labels are learnt.
    """
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("string").alias("_label"), F.col(f"`{text_col}`").alias("_text")).dropna()
    keys = texts.select("_key", "_label").distinct()
    values = [r[0] for r in keys.select("_label").distinct().orderBy("_label").limit(SAMPLE_TEXTS).collect()]
    picked = keys.limit(0)
    for value in values:
        mine = keys.where(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE_TEXTS // len(values))
        picked = picked.union(mine)
    chosen = texts.join(F.broadcast(picked), ["_key", "_label"])  # at most SAMPLE_TEXTS rows
    return chosen.groupBy("_key", "_label").agg(F.min("_text").alias("_text")).select("_label", "_text")


def train(docs: DataFrame, key: str = "doc_id", label: str = "lang", text_col: str = "text") -> Model:
    """The model of labelled ``docs``: frequencies over all of them, weights of the bounded sample by one task."""
    known = docs.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    frequency, texts = document_frequencies(known, text_col)

    def extract(batches):
        for part in (p for batch in batches for p in text_slices(batch, 1)):
            rows = [features(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["label", "at", "n"])

    def run(batches):
        samples = [s for b in batches for s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(samples), frequency, texts))], pa.binary())], ["model"])

    sample = training_sample(docs, key, label, text_col).mapInArrow(extract, "label string, at array<long>, n array<long>")
    fitted = sample.repartition(1).mapInArrow(run, "model binary").collect()  # one model
    return pickle.loads(fitted[0][0]) if fitted else EMPTY


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred string and score double. Narrow: no shuffle."""
    df = drop_clashes(df, *({"lang_pred", "score"} - {text_col}))
    at = df.columns.index(text_col)

    def run(batches):
        for part in (p for batch in batches for p in text_slices(batch, at)):
            labels, scores = model.predict(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
