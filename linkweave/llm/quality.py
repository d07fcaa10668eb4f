"""Quality classifier with hierarchical empirical Bayes.

Two linear models over style figures and telling words are fitted on a bounded sample of labelled documents (FIT rows, the
least hashes): one for low quality, one for toxic text. All documents are scored. Host (source) and path (source and language)
rates come from grouped sums over all documents: the label where there is one, else the model's probability. They are shrunk
by beta priors whose strength is estimated from the spread between sites, paths towards their host, hosts towards the global
rate, so a site with few documents says little. A document is rejected if its evidence together with its site's posterior
makes low quality or toxicity more likely than not.

Edge cases: null text counts as empty; null source or lang are sites of their own; a null doc_id stays and has no label; labels
of unknown documents are ignored, contradicting labels of one document count with their mean; without labels nothing is
rejected; repeated rows are scored each; an empty table gives an empty result; reject_low_quality returns all columns.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, ident, materialise, packed, sent, small_join, tidied

#: Labelled documents that the models are fitted on, words that they look at, and documents a word must occur in.
FIT, TELLING, SEEN = 6000, 400, 4
#: Largest shift, in log odds, that a site may give to a document.
SITE_SHIFT = 1.0
REJECT = 0.5
HEADS = ("low", "toxic")
PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_word = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def style(raw: bytes) -> np.ndarray:
    """Shares of punctuation marks, digits, capitals and repeats, and word sizes."""
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    words = raw.split()
    letters = n[65:91].sum() + n[97:123].sum()
    w = max(1, len(words))
    marks = n[list(PUNCT)] / w
    repeats = sum(a == b for a, b in zip(words, words[1:])) / w
    out = [*np.minimum(marks, 2.0), n[48:58].sum() / max(1, len(raw)), n[65:91].sum() / max(1, letters), repeats,
           len(set(words)) / w, min(20.0, len(raw) / w) / 10, np.log1p(w) / 5]
    return np.array(out, np.float32)


def words_in(raw: bytes) -> set[bytes]:
    return set(_word.findall(raw.lower()))


def _fit_batches(batches):
    return tidied(_features(batches))


def _features(batches):
    for batch in batches:
        figures, words = [], []
        for x in batch.column(1):
            raw = (x.as_py() or "").encode()
            figures.append(style(raw))
            words.append(sorted(w.decode("utf-8", "replace") for w in words_in(raw) if len(w) < 40))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(figures, pa.list_(pa.float32())), pa.array(words, pa.list_(pa.string()))],
            ["doc_id", "figures", "words"],
        )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Figures and telling words, with a weight vector per head."""

    def __init__(self, words: list[bytes], shift: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.at = {w: k for k, w in enumerate(words)}
        self.shift, self.scale, self.weights = shift, scale, weights

    def row(self, raw: bytes) -> np.ndarray:
        x = np.zeros(len(self.shift) + len(self.at))
        x[: len(self.shift)] = (style(raw) - self.shift) / self.scale
        for w in self.at.keys() & words_in(raw):
            x[len(self.shift) + self.at[w]] = 1.0
        return x

    def score(self, raw: bytes) -> list[float]:
        x = self.row(raw)
        return [float(np.clip(x @ w[:-1] + w[-1], -30, 30)) for w in self.weights.values()]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, low, toxic), one row per labelled doc_id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"), F.col("toxic").cast("double").alias("t"))
    return marks.where("doc_id is not null").groupBy("doc_id").agg((1 - F.avg("q")).alias("low"), F.avg("t").alias("toxic"))


def fit(docs: DataFrame, marks: DataFrame) -> Model | None:
    """A model from at most FIT labelled documents: those whose id hashes least."""
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT)
    chosen = materialise(chosen, "chosen")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = small_join(rows, chosen.select("doc_id"), ["doc_id"], "left_semi")
    # One text an id, the one of least digest, so that ids which many rows share don't pass the bound.
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = rows.groupBy("doc_id").agg(F.min_by("text", digest).alias("text"))
    seen = rows.mapInArrow(_fit_batches, "doc_id long, figures array<float>, words array<string>")
    seen = materialise(seen, "features")
    # At most FIT documents: their words that occur often enough, by how unevenly the classes hold them.
    both = seen.join(chosen, "doc_id")
    low, toxic = F.col("low") >= 0.5, F.col("toxic") >= 0.5
    total = both.agg(F.count("*"), F.sum(low.cast("long")), F.sum(toxic.cast("long"))).first()
    if not total[0]:
        return None
    held = both.select("low", "toxic", F.explode("words").alias("w")).groupBy("w").agg(
        F.count("*").alias("n"), F.sum(low.cast("long")).alias("l"), F.sum(toxic.cast("long")).alias("t")
    ).where(F.col("n") >= SEEN)

    def uneven(part: str, of: int) -> Column:
        share = (of or 0) / total[0]
        return F.abs(F.col(part) - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-3))

    words = held.orderBy(F.greatest(uneven("l", total[1]), uneven("t", total[2])).desc(), "w").limit(TELLING).select("w")
    words = sorted(r.w.encode() for r in words.collect())
    known = F.array(*(F.lit(w.decode()) for w in words)) if words else F.array().cast("array<string>")
    data = both.select("figures", "low", "toxic", F.array_intersect("words", known).alias("words")).toPandas()
    discard(seen)
    figures = np.array(data.figures.tolist(), np.float64).reshape(len(data), -1)
    shift, scale = figures.mean(axis=0), figures.std(axis=0) + 0.05
    at = {w: k for k, w in enumerate(words)}
    x = np.zeros((len(data), len(words)))
    for k, held_words in enumerate(data.words):
        x[k, [at[w.encode()] for w in held_words]] = 1.0
    x = np.hstack([(figures - shift) / scale, x])
    return Model(words, shift, scale, {h: logistic(x, data[h].to_numpy()) for h in HEADS})


def _score_batches(batches, model):
    return tidied(_scores(batches, model))


def _scores(batches, model):
    for batch in batches:
        out = [model.score((x.as_py() or "").encode()) for x in batch.column(1)]
        cols = np.array(out).reshape(len(out), len(HEADS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(np.ascontiguousarray(cols[:, k])) for k in range(len(HEADS))), batch.column(2), batch.column(3), batch.column(4)],
            ["doc_id", *HEADS, "source", "lang", "digest"],
        )


def site_rates(scored: DataFrame, head: str) -> tuple[DataFrame, float]:
    """((source, lang, rate), global rate): posterior means of paths, shrunk to their hosts and these to the global rate."""
    y = F.coalesce(F.col(f"{head}_label"), 1 / (1 + F.exp(-F.col(head))))
    path = scored.groupBy("source", "lang").agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("k"))
    host = path.groupBy("source").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    n, k = host.agg(F.sum("hn"), F.sum("hk")).first()
    mean = min(max((k or 0) / n, 1e-4), 1 - 1e-4) if n else 0.5

    def strength(groups: DataFrame, n: str, k: str, centre) -> float:
        """Beta strength by moments: the between-site variance is what binomial noise leaves of the observed one."""
        r = F.col(k) / F.col(n)
        v, noise, m = groups.agg(F.avg((r - centre) ** 2), F.avg(centre * (1 - centre) / F.col(n)), F.avg(centre)).first()
        if v is None or v <= noise:
            return 1000.0
        return float(np.clip(m * (1 - m) / (v - noise) - 1, 2.0, 1000.0))

    s = strength(host, "hn", "hk", F.lit(mean))
    host = host.withColumn("hrate", (F.col("hk") + s * mean) / (F.col("hn") + s))
    joined = path.withColumnsRenamed({"source": "ps"}).join(host, F.col("ps").eqNullSafe(F.col("source")))
    s = strength(joined, "n", "k", F.col("hrate"))
    rate = (F.col("k") + s * F.col("hrate")) / (F.col("n") + s)
    return joined.select("source", "lang", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), rate)).alias(f"{head}_rate")), mean


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, digest, low_evidence, toxic_evidence, low_probability, toxic_probability, rejected) of every document."""
    marks = materialise(labelled(docs, labels), "marks")
    model = fit(docs, marks)
    text = F.col("text").cast("string")
    columns = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), columns["source"].alias("source"), columns["lang"].alias("lang"),
                       F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("digest"))
    if model is None:
        low = F.lit(0.0)
        return rows.select("doc_id", "digest", low.alias("low_evidence"), low.alias("toxic_evidence"), low.alias("low_probability"), low.alias("toxic_probability"), F.lit(False).alias("rejected"))
    kinds = "doc_id long, low double, toxic double, source string, lang string, digest binary"
    scored = materialise(rows.mapInArrow(partial(_score_batches, model=model), kinds), "scored")
    known = scored.join(marks.withColumnsRenamed({h: f"{h}_label" for h in HEADS}), "doc_id", "left")
    known = materialise(known, "known")
    out = known
    for head in HEADS:
        rates, mean = site_rates(known, head)
        rates = sent(materialise(rates, "rates"), source="rs", lang="rl")
        out = out.join(rates, F.col("source").eqNullSafe(F.col("rs")) & F.col("lang").eqNullSafe(F.col("rl"))).drop("rs", "rl")
        rate = F.col(f"{head}_rate")
        shift = F.log(rate / (1 - rate)) - float(np.log(mean / (1 - mean)))
        odds = F.col(head) + F.greatest(F.lit(-SITE_SHIFT), F.least(F.lit(SITE_SHIFT), shift))
        out = out.withColumn(f"{head}_probability", 1 / (1 + F.exp(-odds)))
    bad = (F.col("low_probability") >= REJECT) | (F.col("toxic_probability") >= REJECT)
    return out.select("doc_id", "digest", F.col("low").alias("low_evidence"), F.col("toxic").alias("toxic_evidence"), "low_probability", "toxic_probability", bad.alias("rejected"))


def reject_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones; all columns stay."""
    bad = classify(docs, labels).where("rejected").select(ident(F.col("doc_id")).alias("id"), "digest")
    bad = materialise(bad.distinct(), "rejected")
    return small_join(packed(docs), bad, ["id", "digest"], "left_anti").select("row.*")
