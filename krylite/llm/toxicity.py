"""Counterfactual-regularised toxicity classifier.

Features of a text are its words and word beginnings, by presence. A logistic model is fitted on the driver from a
bounded sample of labelled rows: first with an L1 penalty in proportion to each feature's chance level, which selects
features, then again on those with a small L2 penalty, which gives weights. Both fits carry a second penalty: identity
terms of the labelled texts are swapped for others of their group and the squared change of the score is charged, so
that a neutral mention of a group can't become evidence. Besides the given groups there are groups from the sample
itself: frequent words that both labels have alike, put together if they stand in the same texts. Scoring reads whole
texts on the executors.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, map_texts, materialize, release

WORD = re.compile(r"[^\W\d_]+")
#: Terms that may stand in for one another in a sentence, by group; each is swapped for the next of its group.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "juden", "muslime", "christen", "ausländer"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens", "étrangers"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos", "extranjeros"),
)


@dataclass(frozen=True)
class Settings:
    #: Bound of the labelled rows that the fit reads, taken in the order of a hash of their id.
    max_rows: int = 8000
    min_rows_of_feature: int = 4
    #: L1 penalty in standard deviations of a feature's gradient under chance.
    penalty: float = 4.5
    ridge: float = 2e-4
    counterfactual: float = 1.0
    identity_groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS
    #: Words that make up groups from the sample, and words of such a group.
    derived_terms: int = 24
    derived_group: int = 4


@dataclass
class Model:
    bias: float = -2.0
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        weights, bias, seen = self.weights, self.bias, {}

        def score(text: str) -> float:
            hits: set[int] = set()
            for w in set(WORD.findall(text.lower())):
                got = seen.get(w)
                if got is None:
                    if len(seen) > 200_000:  # bounded memory: looked up again as met
                        seen.clear()
                    got = seen[w] = tuple(f for f in word_features(w) if f in weights)
                if got:
                    hits.update(got)
            z = bias + sum(weights[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return score


def word_features(word: str) -> list[int]:
    names = [f"={word}"] + [f"{word[:n]}-" for n in (4, 5) if len(word) > n]
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in names]


def swaps(groups: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    return {a: b for g in groups for a, b in zip(g, g[1:] + g[:1], strict=True) if a != b}


def text_features(words: set[str], seen: dict[str, list[int]]) -> list[int]:
    for w in words:
        if w not in seen:
            seen[w] = word_features(w)
    return list({f for w in words for f in seen[w]})


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, key: str, text: str) -> DataFrame:
    """key, __y and text of the bounded sample, written once."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    known = known.where(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0)
    chosen = known.orderBy(F.xxhash64(key), key).limit(settings.max_rows)
    return materialize(docs.select(key, text).join(F.broadcast(chosen), key), "tox-sample")  # at most max_rows rows of two numbers


def derived_groups(rows: DataFrame, settings: Settings, key: str, text: str) -> tuple[tuple[str, ...], ...]:
    """Swap groups from the sample: words of 2 to 30 % of its texts whose share of label 1 is within chance, the most
    frequent ones, each put to those that it shares most texts with beyond chance."""
    if settings.derived_terms < 2:
        return ()
    said = map_texts(rows, [key, "__y"], text, "words array<string>", lambda texts: [[sorted(set(WORD.findall(t.lower()))) for t in texts]])
    n, bad = rows.agg(F.count("*"), F.sum("__y")).first()
    if not n or not bad or bad == n:
        return ()
    share = bad / n
    spread = F.sqrt(F.col("n") * share * (1 - share))
    counts = said.select("__y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("__y").alias("bad"))
    even = counts.where((F.col("n") >= 0.02 * n) & (F.col("n") <= 0.3 * n) & (F.length("word") > 2) & (F.abs(F.col("bad") - share * F.col("n")) <= spread))
    given = {w for g in settings.identity_groups for w in g}
    terms = sorted(r["word"] for r in even.orderBy(F.col("n").desc(), "word").limit(settings.derived_terms).collect() if r["word"] not in given)
    if len(terms) < 2:
        return ()
    found = said.select(*[F.array_contains("words", t).cast("double").alias(f"t{i}") for i, t in enumerate(terms)])
    both = found.agg(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s{i}_{j}") for i in range(len(terms)) for j in range(i + 1)]).first()
    c = np.array([[both[f"s{max(i, j)}_{min(i, j)}"] for j in range(len(terms))] for i in range(len(terms))])
    alike = c / np.sqrt(np.outer(c.diagonal(), c.diagonal()))
    left, groups = list(range(len(terms))), []
    while len(left) > 1:
        near = sorted(left[1:], key=lambda j: (-alike[left[0], j], j))[: settings.derived_group - 1]
        groups.append(tuple(terms[j] for j in (left[0], *near)))
        left = [j for j in left if j not in (left[0], *near)]
    return tuple(groups)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, settings: Settings, key: str = "doc_id", text: str = "text"):
    """Labels, features, and the features that come and go under swaps (null without identity terms) of the bounded
    sample, on the driver."""
    rows = sample_rows(docs, labels, label, settings, key, text)
    change = swaps(settings.identity_groups + derived_groups(rows, settings, key, text))

    def work(texts: list[str]) -> list[list]:
        seen: dict[str, list[int]] = {}
        plain, come, go = [], [], []
        for t in texts:
            words = set(WORD.findall(t.lower()))
            own = text_features(words, seen)
            plain.append(own)
            if words & change.keys():
                new = text_features({change.get(w, w) for w in words}, seen)
                come.append(list(set(new).difference(own)))
                go.append(list(set(own).difference(new)))
            else:
                come.append(None)
                go.append(None)
        return [plain, come, go]

    got = map_texts(rows, [key, "__y"], text, "f array<long>, come array<long>, go array<long>", work).toArrow()
    release(rows)
    size = got["f"].combine_chunks().value_lengths().to_numpy()
    order = np.lexsort((size, got["__y"].to_numpy(), np.asarray(got[key].cast("string").to_pylist(), str)))
    got = got.take(order)
    return got["__y"].to_numpy().astype(float), lists(got["f"]), lists(got["come"]), lists(got["go"])


class Lists:
    """Lists of numbers as one array and offsets; a null list is empty and marked."""

    def __init__(self, values: np.ndarray, start: np.ndarray, null: np.ndarray):
        self.values, self.start, self.null = values, start, null

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.null)), np.diff(self.start))

    def take(self, rows: np.ndarray) -> Lists:
        size = np.diff(self.start)[rows]
        at = np.repeat(self.start[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(rows) else np.empty(0, np.int64)
        return Lists(self.values[at], np.concatenate([[0], np.cumsum(size)]), self.null[rows])


def lists(column) -> Lists:
    t = column.combine_chunks()
    size = t.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return Lists(t.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.asarray(t.is_null()))


class Rows:
    """A sparse 0/1 matrix by rows."""

    def __init__(self, features: Lists, names: np.ndarray):
        """Columns are the given features (sorted); others are left out."""
        self.width, self.n = len(names), len(features.null)
        at = np.minimum(np.searchsorted(names, features.values), len(names) - 1)
        known = names[at] == features.values
        self.at, self.row = at[known], features.row[known]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.row], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def descend(x: Rows, d: tuple[Rows, Rows] | None, y: np.ndarray, l1: np.ndarray, l2: float, cf: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic loss + l1 + l2 + cf * mean squared change of score under swaps."""
    n, w = len(y), np.zeros(x.width)
    b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    v, vb, t = w.copy(), b, 1.0

    def value_and_gradient(w, b):
        z = x.dot(w) + b
        p = sigmoid(z)
        loss = float(np.mean(np.logaddexp(0, z) - y * z) + l2 * (w @ w) / 2)
        g = x.back((p - y) / n) + l2 * w
        if d is not None:
            change = d[0].dot(w) - d[1].dot(w)
            loss += cf * float(change @ change) / n
            g += 2 * cf / n * (d[0].back(change) - d[1].back(change))
        return loss, g, float(np.mean(p - y))

    size = 1.0
    for _ in range(rounds):
        loss, g, gb = value_and_gradient(v, vb)
        while True:
            w2 = v - size * g
            w2 = np.sign(w2) * np.maximum(np.abs(w2) - size * l1, 0)
            b2 = vb - size * gb
            dw, db = w2 - v, b2 - vb
            if value_and_gradient(w2, b2)[0] <= loss + g @ dw + gb * db + (dw @ dw + db * db) / (2 * size) + 1e-12 or size < 1e-6:
                break
            size /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        moved = max(float(np.abs(w2 - w).max(initial=0)), abs(b2 - b))
        w, b, t = w2, b2, t2
        size *= 1.5
        if moved < 1e-4:
            break
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model:
    """A model from labelled rows whose crc32(id as text) mod 5 is not 0; without labels of both kinds, a constant one."""
    y, f, come, go = training_rows(docs, labels, label, settings, key, text)
    n = len(y)
    if n == 0:
        return Model()
    p = (y.sum() + 0.5) / (n + 1)
    if y.min() == y.max():
        return Model(float(np.log(p / (1 - p))))
    order = np.argsort(f.values, kind="stable")
    ranked = f.values[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    names = ranked[first]
    if not len(names):
        return Model(float(np.log(p / (1 - p))))
    del ranked
    count = np.diff(np.append(first, len(order)))
    grad = np.abs(np.add.reduceat((y - y.mean())[f.row[order]], first)) / n
    del order
    share = count / n
    chance = np.sqrt(y.mean() * (1 - y.mean()) * np.maximum(share * (1 - share), 1 / n) / n)
    # sequential strong rule: features whose gradient is far under the penalty stay at zero
    held = np.flatnonzero((count >= settings.min_rows_of_feature) & (count < n) & (grad >= 0.6 * settings.penalty * chance))
    if not len(held):
        return Model(float(np.log(p / (1 - p))))
    swapped = np.flatnonzero(~come.null)
    come, go = come.take(swapped), go.take(swapped)

    def matrices(names: np.ndarray):
        return Rows(f, names), (Rows(come, names), Rows(go, names)) if len(swapped) else None

    x, d = matrices(names[held])
    w, _ = descend(x, d, y, settings.penalty * chance[held], 0.0, settings.counterfactual, 150)
    chosen = names[held][np.abs(w) > 1e-6]
    if not len(chosen):
        return Model(float(np.log(p / (1 - p))))
    x, d = matrices(chosen)
    w, b = descend(x, d, y, np.zeros(len(chosen)), settings.ridge, settings.counterfactual, 400)
    return Model(float(b), {int(k): float(v) for k, v in zip(chosen, w, strict=True) if abs(v) > 1e-6})


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and predicted (1 from 0.5 on) of each row; null and empty texts get the model's base score.

    Whole texts are read; equal texts get equal scores; an empty table gives no rows; other columns are ignored. The
    model's size is bounded by the bounded training sample, so it travels with the tasks.
    """

    def work(texts: list[str]) -> list[list]:
        f = scorer_of(model)
        s = [f(t) for t in texts]
        return [s, [int(x >= 0.5) for x in s]]

    return map_texts(df, [key], text, "score double, predicted int", work)


_scorers: dict = {}


def scorer_of(model: Model):
    """The model's scorer with its word cache, one per worker."""
    if _scorers.get("of") != id(model):
        _scorers.update(of=id(model), f=model.scorer(), model=model)
    return _scorers["f"]


def keep_clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `df`, all columns, whose text scores under 0.5."""
    import pyarrow as pa

    return map_rows(df, text, lambda rows, texts: rows.filter(pa.array([scorer_of(model)(t) < 0.5 for t in texts], pa.bool_())))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, by a model that never saw the held-out labels."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
