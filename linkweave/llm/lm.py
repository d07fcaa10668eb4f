"""Scoring documents with a gated recurrent language model (gru.py) trained on the corpus.

Word counts are taken over all training documents. The HEAD most frequent words, a fixed number, go to every executor; the
other words stay distributed and meet their counts in a join, so nothing grows with the vocabulary. The model's own words are
the VOCABULARY most frequent ones. It starts from their corpus frequencies, is warmed up on a bounded sample and then trained
by all partitions at once on all training documents; the partitions' weights are averaged by their numbers of tokens. Words outside its vocabulary have the model's probability of the
unknown word times their smoothed share among such words.

Edge cases: null text counts as empty (its end token is scored); a document with a null doc_id is held out; repeated rows are
scored each; without training documents all words are unknown; words of equal count are told apart by their spelling or its hash; a
very long text is scored whole, in windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidied
from .gru import GRU

#: The end of a document; no word holds white space.
END = "\n"
HEAD, VOCABULARY = 1 << 17, 3968
#: Documents of the warm-up, learning rates.
WARM, RATES = 600, (0.01, 0.003)
#: Tokens that a partition trains on or scores at once, and words of a batch of numbered documents.
TOGETHER, AT_ONCE, NUMBERED = 400_000, 1_600_000, 1_000_000
SMOOTH = 0.1
#: Frequency bands to a doubling and ranges of hashes by which the head words are told from the others.
BANDS, RANGES = 64, 4096


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _count_batches(batches):
    return tidied(_counts(batches))


def _counts(batches):
    for batch in batches:
        n = Counter()
        for x in batch.column(0):
            n.update(words_of(x.as_py()))
        n[END.encode()] += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "c"]
        )


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c): counts of all words and ends of the texts, as a written table."""
    part = texts.mapInArrow(_count_batches, "word string, c long")
    return materialise(part.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "counts")


class Lexicon:
    """The head words with their counts, and how the model numbers them."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int):
        self.index = {w.encode(): k for k, w in enumerate(words)}
        self.total, self.distinct = total, distinct
        c = np.array(counts, np.float64)
        inner = [k for k, w in enumerate(words) if w != END][: VOCABULARY - 1]
        end = [k for k, w in enumerate(words) if w == END]
        model = sorted(inner + end, key=lambda k: (-c[k], words[k]))
        self.model_id = np.full(len(words) + 1, len(model), np.int32)  # the last: words not of the head
        self.model_id[model] = np.arange(len(model))
        self.freq = c[model]
        self.end = model.index(end[0]) if end else 0
        self.end_known = bool(end)
        rest = total - self.freq.sum()
        self.base_norm = math.log10(total + SMOOTH * (distinct + 1))
        self.rest_norm = math.log10(rest + SMOOTH * (distinct - len(model) + 1))
        self.unknown = rest
        self.log_count = np.log10(np.append(c, 0.0) + SMOOTH)
        self.end_log = float(self.log_count[end[0]]) if end else math.log10(SMOOTH)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Head index of each word; those not of the head get the number of head words."""
        return np.fromiter(map(self.index.get, words, repeat(len(self.index))), np.int32, len(words))

    def targets(self, ids: np.ndarray) -> np.ndarray:
        """The model's numbers of a document's words and its end."""
        return np.append(self.model_id[ids], np.int32(self.end))

    def model(self) -> GRU:
        freq = self.freq if len(self.freq) else np.array([1.0])
        return GRU(freq, max(self.unknown, 1.0), self.end)


def head_words(counts: DataFrame, most: int) -> DataFrame:
    """At most `most` rows (word, c): all words of the higher frequency bands, and of the band that fits in part those whose
    hashes are least. Only the sizes of bands and of hash ranges reach the driver, whatever the number of partitions."""
    banded = counts.withColumns({"band": F.floor(F.log2("c") * BANDS), "range": F.pmod(F.xxhash64("word"), F.lit(RANGES))})
    room, low = most, None
    for r in banded.groupBy("band").count().orderBy(F.desc("band")).collect():
        if r["count"] > room:
            low = r.band
            break
        room -= r["count"]
    if low is None:
        return counts.select("word", "c")
    upto = 0
    for r in banded.where(F.col("band") == low).groupBy("range").count().orderBy("range").collect():
        if r["count"] > room:
            break
        room, upto = room - r["count"], r.range + 1
    kept = (F.col("band") > low) | ((F.col("band") == low) & (F.col("range") < upto))
    return banded.where(kept).select("word", "c")


def lexicon_of(counts: DataFrame) -> Lexicon:
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    # HEAD rows at most; the end token is one of them in any case.
    rows = head_words(counts, HEAD).collect()
    if total and not any(r.word == END for r in rows):
        rows += counts.where(F.col("word") == END).collect()
    rows.sort(key=lambda r: (-r.c, r.word))
    return Lexicon([r.word for r in rows], [r.c for r in rows], total or 0, distinct or 0)


def _number_batches(batches, shared):
    return tidied(_numbered(batches, shared))


def _numbered(batches, shared):
    lexicon = shared.value
    head, row = len(lexicon.index), TaskContext.get().partitionId() << 36
    for batch in batches:
        done = 0
        while done < batch.num_rows:
            rows, ids, tails, n, first = [], [], [], 0, done
            while done < batch.num_rows and n < NUMBERED:
                words = words_of(batch.column(1)[done].as_py())
                some = lexicon.ids(words)
                rows.append(row)
                ids.append(some.tobytes())
                tails.append([words[k].decode() for k in np.flatnonzero(some == head)])
                n, row, done = n + len(words), row + 1, done + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0).slice(first, len(rows)), pa.array(ids, pa.binary()), pa.array(tails, pa.list_(pa.string()))], ["row", "doc_id", "ids", "tails"]
            )


def numbered(docs: DataFrame, shared) -> DataFrame:
    """(row, doc_id, ids, tails) of all documents, as a written table: the head index of each word as bytes, and the words that
    have none. Texts are cut into words once for training and scoring."""
    return materialise(docs.mapInArrow(partial(_number_batches, shared=shared), "row long, doc_id long, ids binary, tails array<string>"), "numbered")


def _warm_batches(batches, shared):
    return tidied(_warmed(batches, shared))


def _warmed(batches, shared):
    lexicon = shared.value
    model = lexicon.model()
    docs = [lexicon.targets(np.frombuffer(x.as_buffer(), np.int32)) for batch in batches for x in batch.column(0)]
    for rate in (RATES[0], RATES[0] / 2):
        model.train(docs, rate, lanes=48)
    yield pa.RecordBatch.from_arrays([pa.array([model.flat().astype(np.float32).tobytes()])], ["weights"])


def _train_batches(batches, shared, weights):
    return tidied(_trained(batches, shared, weights))


def _trained(batches, shared, weights):
    lexicon = shared.value
    model = lexicon.model()
    model.load(weights.value)
    docs, n, seen = [], 0, 0
    for batch in batches:
        for x in batch.column(0):
            docs.append(lexicon.targets(np.frombuffer(x.as_buffer(), np.int32)))
            n += len(docs[-1])
            if n >= TOGETHER:
                model.train(docs, RATES[1])
                docs, seen, n = [], seen + n, 0
    model.train(docs, RATES[1])
    if seen + n:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(seen + n)]), pa.array([model.flat().astype(np.float32).tobytes()])], ["part", "tokens", "weights"])


def _average_batches(batches):
    total, tokens = None, 0.0
    for batch in batches:
        for n, w in zip(batch.column(1).to_pylist(), batch.column(2)):
            w = np.frombuffer(w.as_py(), np.float32).astype(np.float64) * n
            total, tokens = (w if total is None else total + w), tokens + n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([tokens]), pa.array([(total / tokens).astype(np.float32).tobytes()])], ["part", "tokens", "weights"])


def train(docs: DataFrame, lexicon: Lexicon, shared) -> np.ndarray:
    """Weights of the model. docs: (doc_id, ids) of the training documents."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(11), "doc_id")
    ids = docs.select("doc_id").orderBy(order, "doc_id").limit(WARM).select("doc_id").distinct()
    # The sample goes to one task, not to the driver, which gets the weights alone.
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").orderBy("doc_id").limit(WARM).select("ids").coalesce(1)
    warm = sample.mapInArrow(partial(_warm_batches, shared=shared), "weights binary").first()
    start = np.frombuffer(warm.weights, np.float32) if warm else lexicon.model().flat()
    weights = spark.sparkContext.broadcast(start)
    kinds = "part long, tokens double, weights binary"
    parts = docs.select("ids").mapInArrow(partial(_train_batches, shared=shared, weights=weights), kinds)
    merged = parts.repartition(16, "part").mapInArrow(_average_batches, kinds).collect()  # 16 rows of the weights' fixed size
    if not merged:
        return start
    tokens = sum(r.tokens for r in merged)
    return (sum(np.frombuffer(r.weights, np.float32).astype(np.float64) * r.tokens for r in merged) / tokens).astype(np.float32)


def _score_batches(batches, shared, weights):
    return tidied(_scored(batches, shared, weights))


def _scored(batches, shared, weights):
    lexicon = shared.value
    model = lexicon.model()
    model.load(weights.value)
    head = len(lexicon.index)
    inside = np.append(lexicon.model_id[:-1] < len(lexicon.freq), True)  # tail words are summed in the join
    log_count = lexicon.log_count.copy()
    log_count[head] = 0.0
    for batch in batches:
        done = 0
        while done < batch.num_rows:
            docs, out, n = [], [], 0
            while done < batch.num_rows and n < AT_ONCE:
                ids = np.frombuffer(batch.column(2)[done].as_buffer(), np.int32)
                known = int((ids != head).sum())
                logs = log_count[ids]
                base = logs.sum() - known * lexicon.base_norm + lexicon.end_log - lexicon.base_norm
                rare = ~inside[ids]
                plus = logs[rare].sum() - rare.sum() * lexicon.rest_norm
                docs.append(lexicon.targets(ids))
                out.append((ids.size + 1, known + lexicon.end_known, base, plus))
                n += ids.size + 1
                done += 1
            lp = model.score(docs) / math.log(10)
            first = done - len(out)
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(out)), batch.column(1).slice(first, len(out)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(np.array(cols[2], np.float64)), pa.array(np.array(cols[3], np.float64) + lp)],
                ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"],
            )


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = rows.where(~held_out(F.col("doc_id")))
    counts = count_words(learn.select("text"))
    lexicon = lexicon_of(counts)
    shared = spark.sparkContext.broadcast(lexicon)
    known = numbered(rows, shared)
    weights = spark.sparkContext.broadcast(train(known.where(~held_out(F.col("doc_id"))), lexicon, shared) if lexicon.total else lexicon.model().flat())
    kinds = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"
    first = materialise(known.select("row", "doc_id", "ids").mapInArrow(partial(_score_batches, shared=shared, weights=weights), kinds), "scores")
    tails = known.select("row", F.explode("tails").alias("word"))
    met = tails.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("logs"), F.count("c").alias("met"), F.count("*").alias("of")
    )
    both = first.join(met, "row", "left")
    logs, met_n, of = (F.coalesce(c, F.lit(0)) for c in ("logs", "met", "of"))
    return both.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + met_n).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"), (F.col("base_score") + logs - of * F.lit(lexicon.base_norm)).alias("base_score"),
        (F.col("score") + logs - of * F.lit(lexicon.rest_norm)).alias("score"),
    )
