"""Toxicity by a counterfactual-regularised classifier (operator 11).

A logistic regression over words and word starts. Beside the labels' loss it pays for every change of score between a labelled sentence that
names a group and the same sentence with the group's name swapped: for another group of its kind, and for the kind's neutral word. What
stands beside a group's name in toxic texts thus cannot make the name itself toxic, and neutral mentions of it are left alone.

Labels are learnt from a bounded sample: of each label the ``SAMPLE`` rows with the least hash (all, where there are fewer), weighted back to
the label's number of rows. The sample's features are counted in Spark, those that tell the labels apart are the vocabulary (``FEATURES`` at
most), and each step of the fit is one Spark job whose tasks return the loss and gradient of their rows. Everything else covers all rows:
scoring is one pass of a UDF that holds the vocabulary.

Inputs of a score are the text's words alone. Defined results: a null or empty text has the score of no features, like any other text
without known words; texts are read whole, in stretches; labels of null doc_id or null toxic teach nothing, several labels of one doc_id count
as toxic if one of them does, and every document of a labelled doc_id is learnt from; without labels every score is 0.5, with one label alone
near it; rows repeat as they come; a null doc_id is not held out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from meterloom.llm.common import texts_of
from meterloom.session import cut

SAMPLE = 40_000  # labelled rows of each label that are learnt from, at most
FEATURES = 20_000  # of the vocabulary, at most
LEAST_DOCS = 3
LEAST_CHI = 10.8  # odds of 1 in 1,000 that a feature has nothing to do with the label
LEAST, MOST = 3, 8  # lengths of word starts
RIDGE = 0.1
FAIRNESS = 4.0  # weight of a squared change of score under a swap
SWAPS = 3  # other groups that a name is swapped for, besides the neutral word
TOXIC = 0.7
PARTS = 16  # tasks of a step of the fit
STEPS = 40
ENTRIES = 200_000  # counts that a task gathers before it hands them on
STRETCH = 1 << 20  # characters of a text that are taken at a time

#: Words for groups, by kind; the first of each is its neutral word. A parameter of ``fit``, to be extended by those who know their corpus.
IDENTITIES = (
    ("people", "women", "men", "girls", "boys", "mothers", "fathers"),
    ("person", "woman", "man", "girl", "boy", "mother", "father"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("local", "black", "white", "asian", "african", "european", "american", "arab", "latino", "hispanic", "indian", "chinese", "mexican", "turkish", "russian", "polish"),
    ("partnered", "gay", "lesbian", "bisexual", "straight", "queer", "transgender", "trans", "homosexual", "heterosexual"),
    ("residents", "immigrants", "refugees", "foreigners", "migrants", "natives"),
    ("tall", "disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("leute", "frauen", "männer", "juden", "muslime", "christen", "ausländer", "flüchtlinge", "türken"),
    ("gens", "femmes", "hommes", "juifs", "musulmans", "chrétiens", "étrangers", "réfugiés", "arabes"),
    ("gente", "mujeres", "hombres", "judíos", "musulmanes", "cristianos", "extranjeros", "refugiados", "gitanos"),
)

_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\W\d_]")
_SENTENCE = re.compile(r"[^.!?\n]+")


def word_counts(text: str) -> Counter:
    """The words of a text in lower case; a long text goes in stretches that end between words."""
    counts, at = Counter(), 0
    while at < len(text):
        end = _BREAK.search(text, min(len(text), at + STRETCH))
        end = end.start() if end else len(text)
        counts.update(_WORD.findall(text[at:end].lower()))
        at = max(end, at + 1)
    return counts


class Vocabulary:
    """The features that a model knows: words, and starts of words, which are marked so that they are no words.

    A word is looked up start by start, only as long as some feature begins like it, so that most words cost one look.
    """

    def __init__(self, names):
        self.words = {name for name in names if not name.endswith("*")}
        self.starts = {name[:-1]: name for name in names if name.endswith("*")}
        self.alive = {name[:k] for name in (*self.words, *self.starts) for k in range(min(LEAST, len(name)), min(len(name), MOST) + 1)}

    def counts(self, words: Counter) -> Counter:
        found, alive, starts, known = Counter(), self.alive, self.starts, self.words
        for word, n in words.items():
            if word[:LEAST] not in alive:
                continue
            if word in known:
                found[word] += n
            for k in range(LEAST, min(len(word), MOST + 1)):
                start = word[:k]
                if start not in alive:
                    break
                if start in starts:
                    found[starts[start]] += n
        return found

    def __len__(self) -> int:
        return len(self.words) + len(self.starts)


def swapped(text: str, identities=IDENTITIES, swaps: int = SWAPS) -> Iterator[tuple[str, str]]:
    """Each sentence that names a group, with each of its counterfactuals: all names of one kind moved on by as many places, or neutral."""
    place = {word: (kind, k) for kind, words in enumerate(identities) for k, word in enumerate(words) if k}
    for found in _SENTENCE.finditer(text):
        sentence = found.group().lower()
        kinds = {place[w][0] for w in _WORD.findall(sentence) if w in place}
        for kind in sorted(kinds):
            words = identities[kind]
            for step in range(min(swaps, len(words) - 2) + 1):

                def other(m, kind=kind, words=words, step=step):
                    of, k = place.get(m.group(), (None, 0))
                    return m.group() if of != kind else words[(k - 1 + step) % (len(words) - 1) + 1] if step else words[0]

                yield sentence, _WORD.sub(other, sentence)


def _vector(words: Counter, vocabulary: Vocabulary, places: dict[str, int]) -> dict[int, float]:
    return {places[name]: math.log1p(n) for name, n in vocabulary.counts(words).items()}


def _feature_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic and clean documents with it, as far as this task sees them."""
    # by label and length of a start; whole words stand under 0
    seen = [{k: Counter() for k in (0, *range(LEAST, MOST + 1))} for _ in range(2)]

    def told() -> Iterator[pa.RecordBatch]:
        for k in seen[0]:
            names = list(seen[0][k] | seen[1][k])
            counts = [pa.array([seen[label][k][n] for n in names], pa.int64()) for label in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([n + "*" for n in names] if k else names, pa.string()), *counts], ["feature", "clean", "toxic"])
            for label in (0, 1):
                seen[label][k].clear()

    for batch in batches:
        for text, label in zip(texts_of(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            words = word_counts(text)
            for k, counts in seen[label].items():
                counts.update({w[:k] for w in words if len(w) > k} if k else words.keys())
            if sum(map(len, seen[label].values())) >= ENTRIES:
                yield from told()
    yield from told()


ROWS = "pair boolean, label int, weight double, at array<int>, value array<double>"


def _rows(names: list[str], identities):
    """The sample as sparse rows: of each document its features, of each swap the difference that it makes."""
    vocabulary, places = Vocabulary(names), {name: k for k, name in enumerate(names)}
    groups = {word for words in identities for word in words[1:]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label, weight in zip(texts_of(batch.column("text")), batch.column("label").to_pylist(), batch.column("weight").to_pylist(), strict=True):
                words = word_counts(text)
                out.append((False, label, weight, _vector(words, vocabulary, places)))
                for said, other in swapped(text, identities) if not groups.isdisjoint(words) else ():
                    a, b = (_vector(word_counts(x), vocabulary, places) for x in (said, other))
                    if moved := {k: d for k in a.keys() | b.keys() if (d := b.get(k, 0.0) - a.get(k, 0.0))}:
                        out.append((True, label, weight, moved))
                if len(out) >= 5000:
                    yield told(out)
                    out = []
            if out:
                yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        vectors = [sorted(x[3].items()) for x in out]
        return pa.RecordBatch.from_pydict({
            "pair": pa.array([x[0] for x in out], pa.bool_()), "label": pa.array([x[1] for x in out], pa.int32()), "weight": pa.array([x[2] for x in out], pa.float64()),
            "at": pa.array([[k for k, _ in v] for v in vectors], pa.list_(pa.int32())), "value": pa.array([[x for _, x in v] for v in vectors], pa.list_(pa.float64())),
        })

    return run


def _gradient(w: np.ndarray, fairness: float):
    """What the rows of a task add to the loss and its gradient; the last weight is the intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad = 0.0, np.zeros(len(w))
        for batch in batches:
            at, value = batch.column("at"), batch.column("value").flatten().to_numpy()
            k = at.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy())
            pair = batch.column("pair").to_numpy(zero_copy_only=False)
            label, weight = batch.column("label").to_numpy().astype(float), batch.column("weight").to_numpy()
            z = np.bincount(row, value * w[k], batch.num_rows)
            d = z + w[-1]
            up = np.where(pair, 2 * fairness * z, 1 / (1 + np.exp(-np.clip(d, -500, 500))) - label) * weight
            loss += float((np.where(pair, fairness * z * z, np.logaddexp(0, d) - label * d) * weight).sum())
            grad[:-1] += np.bincount(k, value * up[row], len(w) - 1)
            grad[-1] += up[~pair].sum()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "loss": pa.array([loss]), "grad": pa.array([grad.tobytes()], pa.binary())})

    return run


def _descend(loss, x: np.ndarray, steps: int = STEPS, kept: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halving steps, until the loss falls by less than one part in 10^6."""
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    f, g = loss(x)
    for _ in range(steps):
        q, shares = g.copy(), []
        for s, y in reversed(moves):
            shares.append(s @ q / (y @ s))
            q -= shares[-1] * y
        q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), share in zip(moves, reversed(shares), strict=True):
            q += s * (share - y @ q / (y @ s))
        step = 1.0
        while True:
            f2, g2 = loss(x - step * q)
            if f2 <= f - 1e-4 * step * (g @ q) or step < 1e-6:
                break
            step /= 2
        if f2 > f:
            break
        s, y = -step * q, g2 - g
        if y @ s > 1e-12:
            moves = [*moves[-kept + 1 :], (s, y)]
        done = f - f2 < 1e-6 * abs(f)
        x, f, g = x + s, f2, g2
        if done:
            break
    return x


class Model:
    """Weights of features, and an intercept."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept, self.vocabulary = weights, intercept, Vocabulary(weights)

    def score(self, text: str) -> float:
        found = self.vocabulary.counts(word_counts(text))
        z = self.intercept + math.fsum(self.weights[name] * math.log1p(n) for name, n in found.items())
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def held_out(doc_id="doc_id"):
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label, weight of the rows to learn from: of each label the ``sample`` of least hash."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    one = one.withColumn("h", F.xxhash64("doc_id"))
    of = one.groupBy("label").agg(F.greatest(F.lit(1.0), F.count(F.lit(1)) / sample).alias("weight"))
    first = [one.where(F.col("label") == k).orderBy("h", "doc_id").limit(sample) for k in (0, 1)]
    return first[0].unionByName(first[1]).join(F.broadcast(of), "label").select(F.col("doc_id").alias("labelled_id"), "label", "weight")


def fit(docs: DataFrame, labels: DataFrame, identities=IDENTITIES, fairness: float = FAIRNESS, sample: int = SAMPLE) -> Model:
    # The sample is at most 2 * ``sample`` ids, so it may be broadcast whatever the corpus; texts are not shuffled to meet it.
    ids = cut(labelled(labels, sample), "labelled")
    learnt = cut(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id")).select("text", "label", "weight"), "learnt")
    counts = learnt.mapInArrow(_feature_docs, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = learnt.agg(F.sum(1 - F.col("label")), F.sum("label")).first()
    clean, toxic = float(totals[0] or 0), float(totals[1] or 0)
    n, a, b = clean + toxic, F.col("toxic").cast("double"), F.col("clean").cast("double")
    chi = n * (a * (clean - b) - b * (toxic - a)) ** 2 / ((a + b) * (n - a - b) * clean * toxic)
    telling = counts.where((a + b >= LEAST_DOCS) & (a + b < n)).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI) if clean and toxic else counts.limit(0).withColumn("chi", F.lit(0.0))
    names = sorted(x["feature"] for x in telling.orderBy(F.desc("chi"), "feature").limit(FEATURES).collect())
    rows = cut(learnt.mapInArrow(_rows(names, identities), ROWS).coalesce(PARTS), "rows")

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.mapInArrow(_gradient(w, fairness), "part int, loss double, grad binary").collect()
        grads = [np.frombuffer(x["grad"]) for x in sorted(parts, key=lambda x: x["part"])]
        ridge = np.append(np.full(len(w) - 1, RIDGE), 1e-3)
        return sum(x["loss"] for x in sorted(parts, key=lambda x: x["part"])) + float(ridge @ (w * w)) / 2, sum(grads, np.zeros(len(w))) + ridge * w

    w = _descend(loss, np.zeros(len(names) + 1)) if n else np.zeros(1)
    return Model({name: float(x) for name, x in zip(names, w, strict=False)}, float(w[-1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    def run(column: pa.Array) -> pa.Array:
        return pa.array([model.score(text) for text in texts_of(column)], pa.float64())

    score = F.arrow_udf(run, DoubleType()).asNondeterministic()
    found = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return scored(docs, fit(docs, labels, **how))
