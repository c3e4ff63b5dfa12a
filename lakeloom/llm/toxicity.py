"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the distinct words of a text and the stems of these words, trained in numpy on confirmed
toxic texts and unlabelled ones. The risk of the negative class is estimated from unlabelled texts minus the
prior's share of the positive ones and is kept from turning negative (the non-negative estimator of Kiryo et al., 2017).
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fitting (a bounded sample of whole texts): confirmed toxic ones, unlabelled ones; features kept; steps.
POSITIVES, UNLABELLED, FEATURES, STEPS = 1500, 4500, 3000, 300
THRESHOLD = 0.7
STEM = (4, 5)
WORD = re.compile(r"[^\W\d_]+")


def features(text: bytes | None) -> set[str]:
    """The distinct lower-cased words and the stems of STEM letters, marked by a final dash."""
    words = set(WORD.findall((text or b"").decode().lower()))
    return words | {w[:n] + "-" for n in STEM for w in words if len(w) > n}


class Classifier:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        w = self.weights
        x = np.fromiter((self.bias + sum(w[f] for f in sorted(features(t) & w.keys())) for t in texts), np.float64, len(texts))
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(positive: list[set[str]], unlabelled: list[set[str]], prior: float, steps: int = STEPS) -> Classifier:
    """Minimise prior R_p(+) + max(0, R_u(-) - prior R_p(-)) with the logistic loss, on texts' features; no example of a class: a constant score of prior."""
    if not positive or not unlabelled:
        return Classifier({}, float(np.log(max(prior, 1e-6)) - np.log1p(-min(prior, 1 - 1e-6))))
    prior = min(max(prior, 1e-3), 0.95)
    sets = [positive, unlabelled]
    share: list[dict[str, float]] = []
    for group in sets:
        counts: dict[str, int] = {}
        for s in group:
            for f in s:
                counts[f] = counts.get(f, 0) + 1
        share.append({f: c / len(group) for f, c in counts.items()})
    least = max(3, 0.004 * len(positive)) / len(positive)
    gain = {f: (p - share[1].get(f, 0)) / np.sqrt(p / len(positive) + share[1].get(f, 0) / len(unlabelled)) for f, p in share[0].items() if p >= least}
    kept = sorted(gain, key=lambda f: (-gain[f], f))[:FEATURES]
    place = {f: i for i, f in enumerate(kept)}
    xp, xu = (np.zeros((len(g), len(kept)), np.float32) for g in sets)
    for x, group in ((xp, sets[0]), (xu, sets[1])):
        for i, s in enumerate(group):
            x[i, [place[f] for f in s if f in place]] = 1
    parts = {"w": np.zeros(len(kept), np.float32), "b": np.array([-2.0], np.float32)}
    adam = common.Adam(parts, 0.1)
    for t in range(steps):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ parts["w"] + parts["b"], -30, 30))) for x in (xp, xu))
        negative = -np.log1p(-su.clip(max=1 - 1e-6)).mean() + prior * np.log1p(-sp.clip(max=1 - 1e-6)).mean()
        gp, gu = (sp - 1) * prior / len(sp), np.zeros_like(su)
        rp = -prior * sp / len(sp)  # gradient of - prior R_p(-)
        ru = su / len(su)
        if negative >= 0:
            gp, gu = gp + rp, ru
        else:  # the estimate went below zero: step back along its own gradient
            gp, gu = -rp, -ru
        shrink = 2e-4 * np.sign(parts["w"]) + 1e-4 * parts["w"]
        adam.step({"w": xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + shrink, "b": np.array([gp.sum() + gu.sum()])}, 1 - t / (steps + 1))
    return Classifier({f: float(w) for f, w in zip(kept, parts["w"], strict=True) if abs(w) > 0.02}, float(parts["b"][0]))


def train(docs: DataFrame, labels: DataFrame, learned, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Fit to at most POSITIVES toxic and UNLABELLED unlabelled texts of the rows that meet learned(name of the id column).

    The prior is the toxic share of all labelled ones. Texts of any length are drawn and read as a whole: tasks find their words,
    and the driver gets these sets. Without toxic labels, or without texts, the model is a constant.
    """
    common.prepare(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("id").isNotNull())
    marks = marks.filter(learned("id"))
    n, toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(learned("id") & F.col("text").isNotNull())
    wanted = common.drawn(marks.filter("toxic = 1").distinct(), 1.5 * POSITIVES / max(1, toxic), POSITIVES, 7, "id").select("id")
    positive = common.drawn(texts.join(F.broadcast(wanted), "id", "left_semi"), 1.0, POSITIVES, 11, "id", "text")  # at most POSITIVES ids
    unlabelled = common.drawn(texts, 1.5 * UNLABELLED / max(1, docs.count()), UNLABELLED, 13, "id", "text")
    sets = [[set(map(sys.intern, r["words"])) for r in df.select(words_of()("text").alias("w")).select("w.words").toLocalIterator()] for df in (positive, unlabelled)]  # one copy of each word
    return fit(*sets, toxic / n if n else 0.0)


def words_of():
    """A UDF: text -> struct(words), the text's features."""
    return common.text_udf(lambda: lambda texts: (pa.array([sorted(features(t)) for t in texts], pa.list_(pa.string())),), "words array<string>")


def scorer(model: Classifier):
    """A UDF: text -> struct(score); null and empty texts have the score of a text without words."""
    return common.text_udf(lambda: lambda texts: (model.scores(texts),), "score double")


def score(docs: DataFrame, model: Classifier, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct column ``out`` (score), null and empty texts included. Equal texts score alike; an empty table gives one; other columns pass through."""
    common.prepare(docs.sparkSession)
    return docs.withColumn(out, scorer(model)(F.col(text_col)))
