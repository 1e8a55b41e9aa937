"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

A text is a bag of sentences, a sentence a bag of *units*: white-space words, lower-cased, without punctuation at
either end, where a run
of single characters ("i d i o t", "i.d.i.o.t", "i - d - i - o - t") is one unit without what is between them, and a word
with several signs between letters ("id...iot") is one without them too. A sentence ends at a full stop, exclamation
or question mark that follows two letters and precedes white space, or at a line end; no word spans one. The kernel of two
units counts their common
subsequences of ``LENGTH`` letters, digits or unit ends, each weighted by ``DECAY`` to the power of the span it covers in
either unit, for spans up to ``SPAN``; it is normalised and raised to ``POWER``, so that many chance
fragments weigh less than one likeness. Punctuation only widens spans, so gaps and
inserted characters cost decay only.
Units beyond ``UNIT_CHARS`` characters are cut into overlapping ones; nothing is left out.

Training takes labelled sentences (each has its text's label). A unit *tells* when it stands in so many more toxic sentences
than chance explains; of sentences that hold it in the same surroundings only the first and the logarithm of the number of others count, as copies of a text prove little. Nyström
landmarks are telling units and frequent clean ones, chosen to differ from each other. A linear
support vector machine (squared hinge) in the landmark space sets telling units and disguised
forms of them, with a character put in, apart from all units of clean sentences. A unit is scored by looking up
its subsequences among the landmarks'; one without any has the bias for its decision. A text scores as its worst sentence,
a sentence as its worst unit, through a logistic curve that crosses 0.5 at a threshold found on texts that the machine
was not trained on: each fold of the sample is judged by a machine of the others.

The sample is bounded by ``SAMPLE_PER_CLASS`` texts of each label, of at most ``SAMPLE_BYTES`` bytes each, in
the order of a hash of their keys; one task fits the model. Scoring covers whole texts of any length.

Edge cases: null and empty texts, and texts without a usable unit, take the lowest unit decision and
so a score near 0; labels that are null are not used; with no label of one class or no telling unit every score is
0; repeated rows score alike; an empty table gives an empty table; input columns named like an
output column are replaced.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontig.llm.common import drop_clashes, released

LENGTH, SPAN, DECAY, POWER = 4, 6, 0.7, 2
LANDMARKS, SAMPLE_BYTES = 160, 65_536
#: Most texts of the sample by label: clean, toxic.
SAMPLE_PER_CLASS = (1600, 800)
UNIT_CHARS = 24
#: Cost of all clean units against that of all toxic ones, and of both together.
CLEAN_COST, COST = 4.0, 1e4
#: Cost of rejected clean texts against missed ones for the threshold, and the share of them that it allows.
RAISED, ALLOWED = 12.0, 0.005
#: Folds for the threshold, disguised forms of each telling unit, share of the proof asked of it (see _tells).
FOLDS, FORMS, PROOF = 4, 16, 1.0
#: Characters put into units for training.
INSERTED = "abcdefghijklmnopqrstuvwxyz*01"
#: Of the logistic curve, per unit of the decision.
SLOPE = 6.0
#: Units whose decision a task remembers before it starts anew (about 150 bytes each).
CACHE_ENTRIES = 200_000
GROUP_CHARS = 250_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"(?<=\w\w[.!?])\s+|[\r\n]+")
#: Symbols of a unit's begin and end.
_FIRST, _LAST = "\x01", "\x02"
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){3,}(?!\S)")
#: Four or more single letters or digits with any white space and punctuation between them.
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_])){3,}")
_DOTTED = re.compile(r"(?:[^\W_](?:[^\w\s]|_)){3,}[^\W_]")
#: Several signs between letters, too wide for ``SPAN``.
_BROKEN = re.compile(r"[^\W_](?:[^\w\s]|_){2,}[^\W_]")
#: Offsets of all subsequences that begin at a position, by their span.
_OFFSETS = [(0, *inner, span - 1) for span in range(LENGTH, SPAN + 1) for inner in combinations(range(1, span - 1), LENGTH - 2)]


def _core(word: str) -> str:
    """``word`` without punctuation at its ends."""
    return word if word[0].isalnum() and word[-1].isalnum() else _EDGE.sub("", word)


def units_of(text: str | None) -> set[str]:
    """The distinct units of a text or sentence."""
    if not text:
        return set()
    low = text.lower()
    units = set(map(_core, set(low.split())))
    if _SPACED.search(low):
        units.update("".join(m.group().split()) for m in _SPACED.finditer(low))
    units.update(re.sub(r"[\W_]", "", m.group()) for m in _SPELLED.finditer(low))
    for word in [u for u in units if not u.isalnum()]:
        units.update(re.sub(r"[\W_]", "", m.group()) for m in _DOTTED.finditer(word))
        if _BROKEN.search(word):
            units.add(re.sub(r"[\W_]", "", word))
    units.discard("")
    long = [u for u in units if len(u) > UNIT_CHARS]
    for u in long:
        units.discard(u)
        units.update(u[a : a + UNIT_CHARS] for a in range(0, max(1, len(u) - UNIT_CHARS // 2), UNIT_CHARS // 2))
    return units


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def features(units: list[str], sought: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, subsequence codes and weights of units, [units, features]; weight 0 where there is none.

    Equal subsequences of a unit are summed, and each row of weights has length 1. With ``sought``, a
    table of hash slots, only units with a subsequence in one of them are returned.
    """
    units = [_FIRST + u + _LAST for u in units]
    width = max((len(u) for u in units), default=1)
    chars = np.zeros((len(units), width + SPAN), np.uint64)
    for size in {len(u) for u in units}:
        rows = [i for i, u in enumerate(units) if len(u) == size]
        points = np.frombuffer("".join(units[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars[rows, :size] = points.reshape(len(rows), size)
    seen, back = np.unique(chars, return_inverse=True)
    word = np.array([chr(c).isalnum() or chr(c) in _FIRST + _LAST for c in seen.tolist()])
    chars[~word[back].reshape(chars.shape)] = 0  # such a character only widens a span
    codes, weights = [], []
    for offsets in _OFFSETS:
        code, full = np.zeros((len(units), width), np.uint64), np.ones((len(units), width), bool)
        for k in offsets:
            full &= chars[:, k : k + width] > 0
            code = code * np.uint64(0x200003) + chars[:, k : k + width]
        codes.append(code)
        weights.append(np.where(full, DECAY ** (offsets[-1] + 1), 0.0))
    code, weight = np.concatenate(codes, 1), np.concatenate(weights, 1)
    code[weight == 0] = 0
    rows = np.arange(len(units))
    if sought is not None:
        rows = np.flatnonzero((sought[_slot(code)] & (weight > 0)).any(1))
        code, weight = code[rows], weight[rows]
    order = np.argsort(code, 1, kind="stable")
    code, weight = np.take_along_axis(code, order, 1), np.take_along_axis(weight, order, 1)
    same = code[:, 1:] == code[:, :-1]
    if same.any():  # the sum of a run of equal codes goes to its last place
        for k in range(code.shape[1] - 1):
            hit = same[:, k]
            weight[hit, k + 1] += weight[hit, k]
            weight[hit, k] = 0
    norm = np.sqrt((weight**2).sum(1, keepdims=True))
    return rows, code, weight / np.where(norm > 0, norm, 1)


@dataclass
class Table:
    """The landmarks' subsequences: sorted codes, and for each a run of (landmark, weight)."""

    codes: np.ndarray
    begin: np.ndarray
    landmark: np.ndarray
    weight: np.ndarray
    size: int

    @classmethod
    def of_landmarks(cls, landmarks: list[str]) -> Table:
        rows, code, weight = features(landmarks)
        row, col = np.nonzero(weight > 0)
        flat, order = code[row, col], np.argsort(code[row, col], kind="stable")
        codes, begin = np.unique(flat[order], return_index=True)
        return cls(codes, np.append(begin, len(flat)), rows[row[order]], weight[row[order], col[order]], len(landmarks))

    def kernels(self, units: list[str], weights: np.ndarray | None = None) -> np.ndarray:
        """Kernel of each unit with each landmark, [units, landmarks], or its product with ``weights``, [units]."""
        out = np.zeros((len(units), self.size) if weights is None else len(units), np.float32)
        if not len(self.codes):
            return out
        sought = np.zeros(1 << 18, bool)
        sought[_slot(self.codes)] = True
        order = np.array(sorted(range(len(units)), key=lambda i: len(units[i])), int)  # blocks of like lengths
        for a in range(0, len(units), 2048):
            block = order[a : a + 2048]
            rows, code, weight = features([units[i] for i in block], sought)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            row, col = np.nonzero((self.codes[at] == code) & (weight > 0))
            first, run = self.begin[at[row, col]], self.begin[at[row, col] + 1] - self.begin[at[row, col]]
            # every match meets the run of landmarks that hold its subsequence
            each = np.repeat(first - np.concatenate([[0], np.cumsum(run)[:-1]]), run) + np.arange(run.sum()) if len(run) else np.empty(0, int)
            cell = np.repeat(row, run) * self.size + self.landmark[each]
            products = np.repeat(weight[row, col], run) * self.weight[each]
            dense = np.bincount(cell, products, len(rows) * self.size).reshape(len(rows), self.size) ** POWER
            out[block[rows]] = dense if weights is None else dense @ weights
        return out


@dataclass
class Model:
    table: Table
    weights: np.ndarray  # of the landmarks
    bias: float
    slope: float
    offset: float

    def decisions(self, units: list[str]) -> np.ndarray:
        return self.table.kernels(units, self.weights) + self.bias

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -30, 30)))

    def worst(self, units: set[str]) -> float:
        return float(self.decisions(sorted(units)).max()) if units else self.bias


EMPTY = Model(Table(np.empty(0, np.uint64), np.zeros(1, int), np.empty(0, int), np.empty(0), 0), np.empty(0), 0.0, 0.0, -30.0)


def _tells(toxic: int, clean: int, share: float, tests: int) -> bool:
    """Whether chance hardly makes one of ``tests`` units, of which ``share`` is toxic, stand out so (Chernoff's bound)."""
    p = toxic / (toxic + clean)
    if p < max(0.8, share + 0.01):
        return False
    divergence = p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0)
    return toxic >= 3 and (toxic + clean) * divergence >= PROOF * np.log(tests)


def _landmarks(telling: list[str], clean: Counter) -> list[str]:
    common = sorted((u for u in clean if len(u) >= 3), key=lambda u: (-clean[u], u))[:600]
    chosen: list[str] = []
    for pool, most in ((telling[:1500], LANDMARKS * 3 // 4), (common, LANDMARKS)):
        kernels = Table.of_landmarks(pool).kernels(pool) if pool else np.zeros((0, 0))
        own: list[int] = []
        for i, unit in enumerate(pool):
            if len(chosen) < most and unit not in chosen and (not own or kernels[i, own].max() < 0.8):
                own.append(i)
                chosen.append(unit)
    return chosen


def _disguised(units: list[str], each: int, rng: np.random.Generator) -> list[str]:
    """``each`` forms of every unit with a character put in at a random inner place."""
    at = [(u, int(rng.integers(1, len(u)))) for u in units for _ in range(each)]
    return [u[:k] + INSERTED[rng.integers(len(INSERTED))] + u[k:] for u, k in at]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the squared hinge machine by Newton steps from ``w``; the last feature is 1. Rows of no cost are left out."""
    reg = np.eye(len(w)) * ridge
    reg[-1, -1] = 1e-3

    def loss(v: np.ndarray) -> float:
        return float(v @ reg @ v + cost @ np.maximum(0, 1 - y * (x @ v.astype(np.float32))) ** 2)

    now = loss(w)
    for _ in range(100):
        active = np.flatnonzero((y * (x @ w.astype(np.float32)) < 1) & (cost > 0))
        left, right = reg.copy(), np.zeros(len(w))
        for a in range(0, len(active), 8192):  # in blocks, so that no copy of the rows is held
            block = active[a : a + 8192]
            weighted = x[block] * cost[block, None].astype(np.float32)
            left += weighted.T @ x[block]
            right += weighted.T @ y[block]
        step = np.linalg.solve(left, right) - w
        size = 1.0
        while (then := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        if now - then < 1e-6 * now:
            break
        w, now = w + size * step, then
    return w


def _threshold(clean: np.ndarray, toxic: np.ndarray, forms: np.ndarray) -> float:
    """Where rejected clean texts, missed toxic texts and missed disguised forms weigh least, with at most ALLOWED of
    the clean texts rejected; three quarters up the widest such gap, as what is new is mostly clean."""
    edges = np.unique(np.concatenate([clean, toxic, forms]))
    cuts = np.concatenate([0.75 * edges[1:] + 0.25 * edges[:-1], edges[-1:] + 0.5])
    gaps = np.append(np.diff(edges), 1.0)
    below = lambda x: np.searchsorted(np.sort(x), cuts) / max(1, len(x))
    raised = 1 - below(clean)
    cost = RAISED * raised + below(toxic) + below(forms) + np.where(raised > ALLOWED, RAISED + 2, 0)
    return float(cuts[np.argmax(np.where(cost <= cost.min() + 1e-12, gaps, -1))])


@dataclass
class _Sample:
    """Labelled texts as rows (unit, surroundings, text), in this order."""

    units: list[str]
    unit: np.ndarray
    around: np.ndarray
    text: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, texts: list[str], labels: list[int]) -> _Sample:
        at: dict[str, int] = {}
        unit, around, where = array("q"), array("q"), array("q")
        for i, text in enumerate(texts):
            rows = set()
            for sentence in _SENTENCE.split(text):
                words = ["", *map(_core, sentence.lower().split()), ""]
                rows.update((x[1], hash(x)) for x in zip(words, words[1:], words[2:]))
            bag = units_of(text)
            rows = {x for x in rows if x[0] in bag}
            rows.update((u, i) for u in bag.difference(x[0] for x in rows))  # spelled-out and cut ones
            for u, h in rows:
                unit.append(at.setdefault(u, len(at)))
                around.append(h)
                where.append(i)
        unit, around, where = (np.array(x, np.int64) for x in (unit, around, where))
        order = np.lexsort((where, around, unit))
        return cls(list(at), unit[order], around[order], where[order], np.array(labels))

    def counts(self, texts: np.ndarray) -> np.ndarray:
        """[clean or toxic, unit]: the chosen texts that hold it in surroundings not met before; the others count as the
        logarithm of their number."""
        out = np.zeros((2, len(self.units)))
        for label in (0, 1):
            mine = (texts & (self.label == label))[self.text]
            unit, around, text = self.unit[mine], self.around[mine], self.text[mine]
            first = np.ones(len(unit), bool)
            first[1:] = (unit[1:] != unit[:-1]) | (around[1:] != around[:-1])
            held, new = (np.bincount(np.unique(x) // len(self.label), minlength=len(self.units)) for x in (unit * len(self.label) + text, (unit * len(self.label) + text)[first]))
            out[label] = new + np.log2(1 + held - new)
        return out

    def worst(self, decisions: np.ndarray, empty: float) -> np.ndarray:
        """The highest decision of each text's units."""
        out = np.full(len(self.label), -np.inf)
        np.maximum.at(out, self.text, decisions[self.unit])
        return np.where(np.isfinite(out), out, empty)


def _telling(units: list[str], counts: np.ndarray, share: float) -> np.ndarray:
    """The places of the telling units, the most frequent first."""
    clean, toxic = counts
    tests = int((toxic > 0).sum())
    found = [i for i in np.flatnonzero(toxic >= 3).tolist() if len(units[i]) >= 3 and _tells(toxic[i], clean[i], share, tests)]
    return np.array(sorted(found, key=lambda i: (-toxic[i], units[i])), int)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Train on a bounded sample of labelled texts."""
    sample = _Sample.of(texts, labels)
    units, y, rng = sample.units, sample.label, np.random.default_rng(0)
    if not (y == 1).any() or not (y == 0).any():
        return EMPTY
    share, every = float((y == 1).mean()), np.ones(len(y), bool)
    counts = sample.counts(every)
    telling = _telling(units, counts, share)
    if not len(telling):
        return EMPTY
    marks = _landmarks([units[i] for i in telling], Counter(dict(zip(units, counts[0].tolist()))))
    table = Table.of_landmarks(marks)
    spectrum, basis = np.linalg.eigh(table.kernels(marks))
    root = basis * (1 / np.sqrt(np.maximum(spectrum, 1e-3))) @ basis.T  # Nyström: K^-1/2
    disguised = [f for i in telling if len(units[i]) > 3 for f in _disguised([units[i]], FORMS, rng)]
    x = np.ones((len(units) + len(disguised), len(marks) + 1), np.float32)
    for a in range(0, len(units), 4096):
        x[a : min(a + 4096, len(units)), :-1] = table.kernels(units[a : a + 4096]) @ root
    x[len(units) :, :-1] = table.kernels(disguised) @ root
    origin = np.concatenate([np.arange(len(units)), np.repeat([i for i in telling if len(units[i]) > 3], FORMS)]).astype(int)

    def machine(chosen: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and which disguised forms come of units that tell in the chosen texts."""
        counts = sample.counts(chosen)
        tells = np.zeros(len(units), bool)
        tells[_telling(units, counts, share)] = True
        known = np.where(tells, np.sqrt(counts[1]), 0)
        forms = np.concatenate([np.zeros(len(units)), known[origin[len(units) :]]])
        clean = np.concatenate([np.where(tells, 0, np.sqrt(counts[0])), np.zeros(len(disguised))])
        known = np.concatenate([known, np.zeros(len(disguised))])
        positive = sum(v / v.sum() / 2 for v in (known, forms) if v.any())
        if not np.any(positive):
            return np.append(np.zeros(len(marks)), -1.0), forms[len(units) :] > 0
        sign = np.where(np.asarray(positive) > 0, 1.0, -1.0)
        clean = CLEAN_COST * clean / max(clean.sum(), 1e-9)
        for _ in range(3):
            w = _svm(x, sign, COST * (positive + clean), w)
            clean = clean * np.where(x @ w.astype(np.float32) > -0.5, 3, 1)  # the hard ones count more the next time
        return w, forms[len(units) :] > 0

    final, _ = machine(every, np.zeros(len(marks) + 1))
    # by the least hash of its units, so that near copies mostly stay in one fold
    least = np.full(len(y), 2**62)
    np.minimum.at(least, sample.text, np.array([xxhash.xxh3_64_intdigest(u.encode("utf-8", "surrogatepass")) >> 2 for u in units], np.int64)[sample.unit])
    fold = least // 7 % FOLDS
    best, forms = np.zeros(len(y)), [np.empty(0)]
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            w, told = machine(fold != k, final)  # the optimum is one, wherever the steps begin
            decisions = x @ w.astype(np.float32)
            best[fold == k] = sample.worst(decisions[: len(units)], w[-1])[fold == k]
            other = _disguised([units[i] for i in np.unique(origin[len(units) :][told])], 2, rng)
            forms.append(table.kernels(other) @ (root @ w[:-1]) + w[-1])
    cut = _threshold(best[y == 0], best[y == 1], np.concatenate(forms))
    return Model(table, root @ final[:-1], float(final[-1]), SLOPE, -SLOPE * cut)


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(text, label): a bounded sample of labelled texts, at most SAMPLE_PER_CLASS of each label."""
    # twice the texts, as some are too large or missing; the labels are narrow
    labelled = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    picked = None
    for value in (0, 1):
        part = labelled.where(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key").limit(2 * SAMPLE_PER_CLASS[value])
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(key).alias("_key"), F.col("text").alias("_text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    joined = texts.join(F.broadcast(picked), "_key")  # at most twice SAMPLE_PER_CLASS rows
    out = None
    for value in (0, 1):
        part = joined.where(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key", "_text").limit(SAMPLE_PER_CLASS[value])
        out = part if out is None else out.union(part)
    return out.select("_text", "_label")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> Model:
    """The model of the bounded sample (see SAMPLE_PER_CLASS), fitted by one task."""

    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, labels))], pa.binary())], ["model"])

    fitted = training_sample(docs, labels, key, label).coalesce(1).mapInArrow(lambda batches: released(run(batches)), "model binary").collect()
    return pickle.loads(fitted[0][0]) if fitted else EMPTY


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with ``score_col``, 0 to 1, and ``worst_unit``, the unit behind it. Narrow: no shuffle."""
    df = drop_clashes(df, *({score_col, "worst_unit"} - {text_col}))
    at = df.columns.index(text_col)

    def run(batches):
        cache: dict[str, float] = {}  # goes with the task: the worker lives on, beside those of other stages

        def group_scores(texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
            bags = [units_of(t) for t in texts]
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            new = list(set().union(*bags).difference(cache.keys()))
            cache.update(zip(new, model.decisions(new).tolist(), strict=True))
            get, decisions, worst = cache.__getitem__, [], []
            for bag in bags:
                found = list(map(get, bag))
                decisions.append(max(found, default=model.bias))
                worst.append(max((u for u, d in zip(bag, found) if d == decisions[-1]), default=None))
            return model.probability(np.array(decisions)), worst

        for batch in batches:
            scores, units, group, held = [], [], [], 0
            for value in batch.column(at):
                text = value.as_py()
                group.append(text)
                held += len(text or "")
                if held >= GROUP_CHARS:
                    s, u = group_scores(group)
                    scores.append(s)
                    units += u
                    group, held = [], 0
            s, u = group_scores(group)
            scores.append(s)
            units += u
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores)), pa.array(units, pa.string())], [*batch.schema.names, score_col, "worst_unit"])

    schema = T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField("worst_unit", T.StringType())])
    return df.mapInArrow(lambda batches: released(run(batches)), schema)
