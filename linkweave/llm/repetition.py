"""Quality rules: counts of words, symbols and repeated lines, and repetition found by a suffix array over each text's words.

The texts of a batch are laid end to end as word numbers that no two texts share, so one prefix doubling sorts the suffixes of
all of them. Common prefixes of neighbours give the intervals of suffixes that share a prefix; an interval whose suffixes have
different words (or the text's start) before them is a maximal repeat. The spans of maximal repeats of LEAST or more words are
united; a text fails if they cover more than COVERED of its words or if the longest has more than LONGEST of its words and more
than LONGEST_WORDS. Every number is exact: words are compared as numbers of a dictionary, never by hash.

One pass without a shuffle. Texts are taken in lots of LOT bytes, a longer one alone, so memory is bounded by the lot or the
longest text (about 100 bytes a word).

Edge cases: a null text counts as empty (no words, fails); a very long text is read whole in time n log n; a null doc_id and
repeated rows give a row each; ties don't arise; an empty table gives an empty result; other columns, of any name, are ignored,
except in reject_repetitive, which returns them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import tidied

#: Words of a repeat that counts; share of a text's words that repeats may cover; longest repeat as a share and in words.
LEAST, COVERED, LONGEST, LONGEST_WORDS = 10, 0.3, 0.2, 50
FEWEST, WINDOW, REPEATED = 50, 3, 50
LOT = 4 << 20
SYMBOLS = b"#*$%&|<>"


class Suffixes(NamedTuple):
    """Suffixes in order; common[k] is the words that order[k - 1] and order[k] share, 0 where they are of different texts."""

    order: np.ndarray
    common: np.ndarray


def suffix_array(word: np.ndarray, text: np.ndarray) -> Suffixes:
    """Sort the suffixes of all texts: word[i] is the number of the i-th word, text[i] of its text (rising)."""
    n = len(word)
    if not n:
        return Suffixes(np.zeros(0, np.int64), np.zeros(0, np.int64))
    end = np.searchsorted(text, text, side="right")
    key = text.astype(np.int64) * (int(word.max()) + 1) + word
    at = np.argsort(key)
    rank = np.empty(n, np.int64)
    starts = _starts(key[at])
    rank[at] = starts
    order = at.copy()
    levels, h = [rank.copy()], 1
    live = at[_shared(starts)]
    while len(live):
        ahead = live + h
        # A suffix that ends here comes first; only one of a text ends at any distance, so it stands alone from now on.
        second = np.where(ahead < end[live], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + second
        by = np.argsort(key)
        live, old = live[by], rank[live[by]]
        first = old + _starts(key[by]) - _starts(old)
        rank[live] = first
        levels.append(rank.copy())
        order[first + _offsets(first)] = live
        live = live[_shared(first)]
        h *= 2
    return Suffixes(order, _common_prefixes(order, levels, end, n))


def _starts(values: np.ndarray) -> np.ndarray:
    """For each place the first place of its run of equal values."""
    change = np.ones(len(values), bool)
    change[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(change, np.arange(len(values)), 0))


def _offsets(values: np.ndarray) -> np.ndarray:
    return np.arange(len(values)) - _starts(values)


def _shared(values: np.ndarray) -> np.ndarray:
    """Whether a neighbour has the same value; equal values stand together."""
    same = values[1:] == values[:-1]
    out = np.zeros(len(values), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _common_prefixes(order, levels, end, n):
    """Levels of doubling hold equal ranks where 2^level words agree; descend them for all neighbours at once."""
    common = np.zeros(n, np.int64)
    k = 1 + np.nonzero(levels[0][order[1:]] == levels[0][order[:-1]])[0]
    a, b = order[k - 1].copy(), order[k].copy()
    last_a, last_b = end[a], end[b]
    for level in range(len(levels) - 1, -1, -1):
        rank, inside = levels[level], (a < last_a) & (b < last_b)
        equal = np.zeros(len(k), bool)
        equal[inside] = rank[a[inside]] == rank[b[inside]]
        step = equal.astype(np.int64) << level
        common[k] += step
        a += step
        b += step
    return common


def longest_from(s: Suffixes) -> np.ndarray:
    """For each word place the words of the longest repeat that starts there."""
    out = np.zeros(len(s.order), np.int64)
    nearest = s.common.copy()
    nearest[:-1] = np.maximum(nearest[:-1], s.common[1:])
    out[s.order] = nearest
    return out


def maximal_repeats(s: Suffixes, word: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, words, places) of each maximal repeat of least or more words: an interval of common prefixes that can't be extended left."""
    low, high, size = [], [], []
    held = np.nonzero(s.common >= least)[0]
    open_at: list[tuple[int, int]] = []  # (first suffix, words) of intervals that are not closed yet, shortest first
    before = -2
    for k, words in zip(held.tolist(), s.common[held].tolist()):
        if k != before + 1:
            _close(open_at, 0, before, low, high, size)
        from_here = _close(open_at, words, before, low, high, size, k - 1)
        if not open_at or open_at[-1][1] < words:
            open_at.append((from_here, words))
        before = k
    _close(open_at, 0, before, low, high, size)
    low, high, size = (np.array(x, np.int64) for x in (low, high, size))
    at = s.order
    left = np.where((at > 0) & (text[at] == text[np.maximum(at - 1, 0)]), word[np.maximum(at - 1, 0)], -1 - at)  # a text's start is like no word
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]) if len(at) else np.zeros(0, np.int64)
    maximal = changes[high] > changes[low]
    return text[at[low[maximal]]], size[maximal], (high - low + 1)[maximal]


def _close(open_at, words, last, low, high, size, start=0):
    """Close the open intervals of more than words; the first suffix of an interval of words that takes their place."""
    while open_at and open_at[-1][1] > words:
        start, w = open_at.pop()
        low.append(start)
        high.append(last)
        size.append(w)
    return start


def covered(length: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text under the union of the spans [i, i + length[i])."""
    n = len(length)
    reach = np.arange(n) + length
    furthest = np.maximum.accumulate(reach) if n else reach  # spans end within their text, so none reaches into the next
    return np.bincount(text[furthest > np.arange(n)], minlength=texts)


def _lots(column: pa.Array):
    """(first row, rows) of lots of at most LOT bytes or one text."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for k, x in enumerate(size.tolist()):
        if total and total + x > LOT:
            yield lo, k - lo
            lo, total = k, 0
        total += x
    if len(size) > lo:
        yield lo, len(size) - lo


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word in a dictionary, number of its text); words are what ASCII white space parts."""
    parts = pc.ascii_split_whitespace(column)
    text = np.repeat(np.arange(len(column)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    text = text[full.to_numpy(zero_copy_only=False)]
    word = pc.dictionary_encode(flat.filter(full)).indices.to_numpy(zero_copy_only=False)
    return word.astype(np.int64), text


_IN_WORD, _SYMBOL = np.zeros(256, np.int64), np.zeros(256, np.int64)
_IN_WORD[[b for b in range(256) if not 0x80 <= b < 0xC0 and b != 0x20 and not 0x09 <= b <= 0x0D]] = 1  # one byte of each code point
_SYMBOL[list(SYMBOLS)] = 1



def measured(column: pa.Array) -> dict[str, np.ndarray]:
    """All counts of a lot of texts."""
    column = pc.fill_null(column, "")
    texts = len(column)
    word, text = _words(column)
    s = suffix_array(word, text)
    length = longest_from(s)
    long_ones = np.where(length >= LEAST, length, 0)
    of, words, _ = maximal_repeats(s, word, text)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, of, words)
    raw = [t.as_buffer().to_pybytes() for t in column.cast(pa.binary())]
    byte = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in raw]).reshape(texts, 256)
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in raw]
    return {
        "n_words": np.bincount(text, minlength=texts),
        "word_chars": byte @ _IN_WORD,
        "n_symbols": byte @ _SYMBOL,
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": covered(np.where(length >= WINDOW, WINDOW, 0), text, texts),
        "n_repeats": np.bincount(of, minlength=texts),
        "covered_words": covered(long_ones, text, texts),
        "longest_repeat": longest,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "covered_words", "longest_repeat")
KINDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_repeats long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    n = m["n_words"]
    failed = (n < FEWEST) | (100 * m["n_repeat_words"] > REPEATED * n)
    repetitive = (m["covered_words"] > COVERED * n) | ((m["longest_repeat"] > LONGEST * n) & (m["longest_repeat"] > LONGEST_WORDS))
    return failed, ~failed & ~repetitive


def _rule_batches(batches):
    return tidied(_rules(batches))


def _rules(batches):
    for batch in batches:
        for lo, n in _lots(batch.column(1)):
            m = measured(batch.column(1).slice(lo, n))
            failed, kept = verdict(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), *(pa.array(m[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(kept)],
                ["doc_id", *COUNTS, "base_failed", "kept"],
            )


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_repeats, covered_words, longest_repeat, base_failed, kept) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rule_batches, KINDS)


def reject_repetitive(docs: DataFrame) -> DataFrame:
    """The documents that pass, all columns as they are."""
    names = docs.columns
    numbered = docs.toDF(*(f"c{k}" for k in range(len(names))))
    at = names.index("text")

    def passed(batches):
        for batch in batches:
            for lo, n in _lots(batch.column(at)):
                part = batch.slice(lo, n)
                yield part.append_column("kept", pa.array(verdict(measured(part.column(at)))[1]))

    schema = StructType([*numbered.schema.fields, StructField("kept", BooleanType())])
    return numbered.mapInArrow(lambda b: tidied(passed(b)), schema).where("kept").drop("kept").toDF(*names)
