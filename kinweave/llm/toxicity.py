"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the presence of words and word beginnings learn from confirmed toxic documents and
unlabelled ones. Their risk is pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)) with the class
prior pi: where the second part falls below zero, training steps against it instead, so
unlabelled toxic documents are not learned as clean ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .tokens import slices, split_words

#: Confirmed toxic documents and documents of any kind, taken as unlabelled, trained on, about: bounded samples by a hash of
#: the id. The second bounds what the risk of unlabelled text is estimated from; all documents are scored.
POSITIVES, UNLABELLED = 2000, 6000
#: Words that carry weight: those in at least so many of the confirmed documents whose share of these lies so many standard
#: errors, at least, above their share of unlabelled ones, and that occur in toxic documents more often than not.
OFTEN, APART = 3, 5
#: Classifiers, each with its own half of the unlabelled; their scores are averaged.
CLASSIFIERS, STEPS, RATE, DECAY = 3, 150, 0.05, 3e-3
#: A document is toxic from this score on.
THRESHOLD = 0.3

_marks = r"[^\pL\pN]+"


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray  # classifier, word
    bias: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        texts = [t or "" for t in texts]
        for a, b in slices(texts):
            row, word, _ = present(texts[a:b], self.words)
            logit = np.repeat(self.bias[:, None], b - a, axis=1)
            for k in range(len(logit)):
                logit[k] += np.bincount(row, self.weights[k][word], b - a)
            out[a:b] = (1 / (1 + np.exp(-np.clip(logit, -500, 500)))).mean(axis=0)
        return out


def words_of(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words are runs of letters and digits in lower case."""
    return split_words(pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), _marks, " "))


def features(word: str) -> tuple[str, ...]:
    """A word and its first four and five letters, which many inflected words share."""
    return (word, f"{word[:4]}*", f"{word[:5]}*") if len(word) > 4 else (word,)


def present(texts: list[str], words: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, feature) for each feature that a text has, once; without ``words``, of all features, which come third."""
    codes, distinct, bounds = words_of(texts)
    names: dict[str, int] = {} if words is None else words
    pairs = [(k, names.setdefault(f, len(names)) if words is None else names.get(f, -1)) for k, w in enumerate(distinct) if w for f in features(w)]
    pairs = [x for x in pairs if x[1] >= 0]
    of = np.array(pairs, np.int64).reshape(-1, 2)
    begins, ends = (np.searchsorted(of[:, 0], np.arange(len(distinct)), side) for side in ("left", "right"))
    each = (ends - begins)[codes]
    row = np.repeat(np.repeat(np.arange(len(texts)), np.diff(bounds)), each)
    at = np.arange(each.sum()) + np.repeat(begins[codes] - np.cumsum(each) + each, each)
    both = np.unique(row * max(1, len(names)) + of[at, 1])
    return both // max(1, len(names)), both % max(1, len(names)), list(names) if words is None else []


def fit(positive: tuple, unlabelled: tuple, n_words: int, prior: float, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias for (rows, words, number of rows) of each kind: Adam steps on the corrected logistic risk."""
    w, b = np.zeros(n_words), float(np.log(prior / (1 - prior)))
    moment, square = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for step in range(1, STEPS + 1):
        risk, grads = {}, {}
        for name, (rows, words, n), sign in (("p+", positive, 1), ("p-", positive, -1), ("u-", unlabelled, -1)):
            margin = sign * (b + np.bincount(rows, w[words], n))
            slope = -sign / (1 + np.exp(np.clip(margin, -500, 500))) / max(1, n)
            risk[name] = np.logaddexp(0, -margin).sum() / max(1, n)
            grads[name] = np.append(np.bincount(words, slope[rows], n_words), slope.sum())
        negative = risk["u-"] - prior * risk["p-"]
        grad = prior * grads["p+"] + grads["u-"] - prior * grads["p-"] if negative >= 0 else prior * grads["p-"] - grads["u-"]
        grad[:-1] += DECAY * w * prior
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from documents whose fold of four is not 2. Several labels of a document: toxic if any says so. The prior is
    the share of toxic ones among labelled documents of those folds. The words and rows that come to the driver are those of
    the two bounded samples. Without a confirmed toxic document every score is 0."""
    spark = docs.sparkSession
    base.short_batches(spark)
    docs = base.only(docs, "doc_id", "text").where((base.fold("doc_id", 4) != 2) & F.col("text").isNotNull())
    marked = labels.where((base.fold("doc_id", 4) != 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen, toxic = marked.agg(F.count("*"), F.count(F.when(F.col("toxic") == 1, 1))).first()
    if not toxic:
        return Model({}, np.zeros((1, 0)), np.array([-np.inf]))
    prior = min(0.5, max(1e-4, toxic / seen))
    ticket = F.pmod(F.xxhash64("doc_id", F.lit("pu")), F.lit(1 << 30))
    confirmed = F.broadcast(marked.where((F.col("toxic") == 1) & (ticket < int(min(1, POSITIVES / toxic) * (1 << 30)))).select("doc_id"))  # POSITIVES rows or so
    positive = docs.join(confirmed, "doc_id", "left_semi")
    unlabelled = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("any")), F.lit(1 << 30)) < int(min(1, UNLABELLED / max(1, docs.count())) * (1 << 30)))

    def distinct(batches):
        for batch in batches:
            _, found, names = present(batch.column("text").to_pylist())
            n = np.bincount(found, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])

    def by_word(df, name):
        return df.select("text").mapInArrow(distinct, "word string, n long").groupBy("word").agg(F.sum("n").alias(name))

    n_pos, n_any = max(1, positive.count()), max(1, unlabelled.count())
    both = by_word(positive, "p").where(f"p >= {OFTEN}").join(by_word(unlabelled, "u"), "word", "left").selectExpr("word", f"p / {n_pos} as p", f"(coalesce(u, 0) + 1) / ({n_any} + 2) as u")
    told = both.withColumn("z", F.expr(f"(p - u) / sqrt(u * (1 - u) / {n_pos})")).where((F.col("z") > APART) & (prior * F.col("p") > 0.5 * F.col("u")))
    words = {r.word: k for k, r in enumerate(told.orderBy(F.desc("z"), "word").collect())}
    shared = spark.sparkContext.broadcast(words)

    def featured(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            row, word, _ = present(texts, shared.value)
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(word, pa.int32()))], ["words"])

    def gathered(df):
        lists = df.select("text").mapInArrow(featured, "words array<int>").toArrow()["words"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(lists)), sizes), pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), len(lists)

    p, (rows, word, n) = gathered(positive), gathered(unlabelled)
    fitted = []
    for k in range(CLASSIFIERS):
        chosen = np.random.default_rng(k).random(n) < 0.7 if n > 100 else np.ones(n, bool)
        on, place = chosen[rows], np.cumsum(chosen) - 1
        fitted.append(fit(p, (place[rows[on]], word[on], int(chosen.sum())), len(words), prior))
    weights = np.array([w for w, _ in fitted])
    return Model(words, weights, np.array([b for _, b in fitted]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; a null text is scored as an empty one."""
    spark = docs.sparkSession
    base.short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            s = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = base.only(docs, "doc_id", "text").select("doc_id", "text", (base.fold("doc_id", 4) == 2).alias("held_out"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score below THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    base.short_batches(docs.sparkSession)

    def kept(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column("text").to_pylist()) < THRESHOLD))

    return docs.mapInArrow(kept, docs.schema)
