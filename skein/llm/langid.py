"""Language identification with averaged hashed subword embeddings and a linear softmax.

A word gives its character n-grams and itself; each is hashed into a table of embeddings, a text is the average over all of its
words, and a linear softmax reads the average. The model is trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows. Averaging is linear, so a trained model needs only one score vector per n-gram: tasks keep the sums of words
they have met and handle a text as counts of words.

Scores are calibrated with a temperature on rows kept from the training. A text is rejected below the lowest threshold from which
on at least ``PRECISION`` of the kept calibration rows are right, as far as ``KEEP`` of the rightly predicted rows stay; where wrong
rows ask for none, it is 0.5 or what ``KEEP`` allows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.llm.common import ready

SAMPLE_ROWS = 2000       # bound of the labelled sample the model is fitted on
BUCKETS = 1 << 15
DIMENSIONS = 16
NGRAMS = (2, 3, 4)
EPOCHS = 6
RATE = 0.5
PRECISION = 0.995
KEEP = 0.995
CACHE_WORDS = 300_000
SLICE_ROWS = 256
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that no training may use: crc32 of the id as text leaves 2 when divided by 4. A row without an id counts as the id ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def subwords(word: str, buckets: int) -> list[int]:
    marked = f"<{word}>".encode()
    grams = [crc32(marked)]
    text = f"<{word}>"
    for n in NGRAMS:
        grams += [crc32(text[i:i + n].encode()) for i in range(len(text) - n + 1)]
    return [g % buckets for g in grams]


def word_counts(text: str | None) -> Counter:
    """Letter words of the whole text in lower case; empty if the text has no letter."""
    words = Counter(_LETTERS.findall((text or "").lower()))
    return words if any(any(map(str.isalpha, w)) for w in words) else Counter()


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray        # for each bucket and label: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def __post_init__(self):
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.labels) + 1))  # summed scores of a word's subwords, and their number

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "sums")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.__post_init__()
            fresh = list(words)
        grams = [subwords(w, len(self.scores)) for w in fresh]
        sizes = np.array([len(g) for g in grams])
        flat = self.scores[np.concatenate(grams)]
        sums = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        first = len(self.known)
        self.known.update((w, first + i) for i, w in enumerate(fresh))
        while len(self.known) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[first:first + len(fresh), :-1] = sums
        self.sums[first:first + len(fresh), -1] = sizes

    def logits(self, texts: list[Counter]) -> np.ndarray:
        """One row for each text, zeros for a text without words."""
        out = np.zeros((len(texts), len(self.labels)))
        for at, words in enumerate(texts):
            if words:
                self.learn(words.keys())
                rows = self.sums[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
                total = np.fromiter(words.values(), float, len(words)) @ rows
                out[at] = total[:-1] / total[-1] + self.bias
        return out

    def probabilities(self, texts: list[Counter]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[Counter], langs: list[str], buckets: int = BUCKETS, seed: int = 7) -> Model:
    """Fit on three quarters of the rows, calibrate on the rest."""
    labels = sorted(set(langs))
    target = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    bags = []
    for words in texts:
        bag: Counter = Counter()
        for word, n in words.items():
            for g in subwords(word, buckets):
                bag[g] += n
        ids = np.fromiter(bag, np.int64, len(bag))
        share = np.fromiter(bag.values(), float, len(bag))
        bags.append((ids, share / share.sum()))
    order = rng.permutation(len(bags))
    fit, calibrate = (order[: -(len(order) // 4)], order[-(len(order) // 4):]) if len(order) >= 8 else (order, order)
    table = rng.normal(0, 0.1, (buckets, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, len(labels))), np.zeros(len(labels))
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            ids, share = bags[i]
            hidden = share @ table[ids]
            error = softmax((hidden @ weights + bias)[None])[0]
            error[target[i]] -= 1
            rate = RATE * (1 - step / steps)
            pull = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * error
            # every subword takes the whole text's error by its share, scaled up as the shares are small
            table[ids] -= rate * np.minimum(share * 20, 1)[:, None] * pull
            step += 1
    model = Model(labels, table @ weights, bias)
    logits = model.logits([texts[i] for i in calibrate])
    truth = target[calibrate]
    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    model.threshold = threshold(p.max(axis=1), p.argmax(axis=1) == truth)
    return model


def threshold(scores: np.ndarray, right: np.ndarray) -> float:
    """The lowest score from which on ``PRECISION`` of the rows are right, but 0.5 at least, and never so high that less than
    ``KEEP`` of the right rows stay."""
    if not right.any():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(scores) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True)
    fine = np.flatnonzero((share >= PRECISION) & last)
    asked = scores[order][fine[-1]] if len(fine) else 1.0
    floor = np.quantile(scores[right], 1 - KEEP, method="lower")
    return float(min(max(asked if not right.all() else 0.0, 0.5), floor))


def labelled_sample(docs: DataFrame, bound: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """At most ``bound`` labelled rows, drawn by the hash of their id from all rows that training may use, language by language.

    Each language gives the same number of rows, or all it has; what small ones leave free goes to the others.
    """
    usable = ready(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    left, quota = bound, bound
    for i, size in enumerate(sorted(sizes.values())):
        quota = max(left // (len(sizes) - i), 1)
        if size > quota:
            break
        left, quota = left - size, bound
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30))
    # about twice the quota goes into the exact draw; languages up to that size whole
    cut = F.lit(1 << 30)
    for lang, size in sizes.items():
        if size > 2 * quota + 100:
            cut = F.when(F.col(lang_col) == lang, int((2 * quota + 100) / size * (1 << 30))).otherwise(cut)
    near = usable.where(drawn < cut).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), drawn.alias("__drawn"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("__drawn", F.xxhash64("text")))
    return near.withColumn("__place", place).where(F.col("__place") <= quota).orderBy("__place", "lang").limit(bound).select("text", "lang")


def fit(docs: DataFrame, bound: int = SAMPLE_ROWS, **columns) -> Model:
    """Train on a bounded sample of labelled rows. Without any labelled row every text is ``und``."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [word_counts(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "words": [list(c) for c in found], "n": [list(c.values()) for c in found]})

    sample = labelled_sample(docs, bound, **columns)
    rows = sample.mapInPandas(count, "lang string, words array<string>, n array<int>").toPandas()
    texts = [Counter(dict(zip(w, n))) for w, n in zip(rows["words"], rows["n"])]
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: (rows["lang"][i], len(texts[i]), sorted(texts[i].items())[:20]))
    if not order:
        return Model([], np.zeros((1, 0)), np.zeros(0))
    return train([texts[i] for i in order], [rows["lang"][i] for i in order])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and ``lang_pred``, ``score``, ``rejected`` (replaced where a column has that name).

    ``lang_pred`` is a learned label, or ``und`` with score 0 for texts that are null or have no letter. ``rejected`` is true
    for ``und`` and below the calibrated threshold. Only the text is looked at; every row is predicted by itself.
    """
    kept = ready(docs).drop(*[c for c in ("lang_pred", "score", "rejected") if c in docs.columns])
    return kept.withColumn("__guess", _guess(model)(F.col(text_col))).select("*", "__guess.*").drop("__guess")


def known_languages(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, with just its columns, without the rejected rows."""
    return ready(docs).where(~_guess(model)(F.col(text_col))["rejected"])


def _guess(model: Model):
    labels = np.array([*model.labels, UNKNOWN], object)

    def answer(part: pd.Series) -> pd.DataFrame:
        texts = [word_counts(t) for t in part]
        known = np.array([bool(t) and bool(model.labels) for t in texts])
        p = model.probabilities(texts) if model.labels else np.zeros((len(texts), 1))
        score = np.where(known, p.max(axis=1), 0.0)
        return pd.DataFrame({"lang_pred": labels[np.where(known, p.argmax(axis=1), -1)], "score": score,
                             "rejected": ~known | (score < model.threshold)})

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [answer(batch.iloc[i:i + SLICE_ROWS]) for i in range(0, len(batch), SLICE_ROWS)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})

    return F.pandas_udf(run, "lang_pred string, score double, rejected boolean")
