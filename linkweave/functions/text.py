"""Text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Without bracket citations and PubMed references; line ends become spaces."""
    text = F.regexp_replace(text, r"\[[^\]]*\]", "")
    text = F.regexp_replace(text, r"\(PubMed:[^)]*\)", "")
    return F.translate(text, "\r\n", "  ")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def affirmed(text: Column, denials: tuple[str, ...] = ("not", "contraindicated")) -> Column:
    """Sentences that hold none of the denials as a substring."""
    def plain(s):
        ok = F.lit(True)
        for d in denials:
            ok = ok & ~F.lower(s).contains(d)
        return ok

    return F.filter(sentences(text), plain)


def pieces(text: Column, separator: str = r"\s*\|\s*") -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, separator, "; "), "; "), lambda x: F.trim(x)), lambda x: x != "")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def text_or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def isolated_abbreviation(word: Column) -> Column:
    """All letters upper case, and there is one."""
    return (F.upper(word) == word) & (F.lower(word) != word)


def phase(text: Column) -> Column:
    """Trial phases: 1 or 2 wins over 3 or 4."""
    return F.when(text.contains("1") | text.contains("2"), "12").when(text.contains("3") | text.contains("4"), "34")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1 + F.exp(-F.abs(x))))


def joined_actions(actions: Column) -> Column:
    """Actions joined by bars; where the first one says that it isn't known, unknown alone."""
    vague = F.get(actions, F.lit(0)).isin("other", "unknown", "other/unknown")
    return F.when(vague, "unknown").otherwise(F.array_join(actions, "|"))


def append_if_absent(array: Column, value: Column) -> Column:
    return F.when(value.isNull() | (value == "") | F.array_contains(array, value), array).otherwise(F.array_append(array, value))


def finite(x: Column, nan: float = 0.0, posinf: float = 0.0, neginf: float = 0.0) -> Column:
    """Null and NaN, and the infinities, replaced by numbers."""
    x = F.coalesce(F.nanvl(x, F.lit(nan)), F.lit(nan))
    return F.when(x == float("inf"), posinf).when(x == float("-inf"), neginf).otherwise(x)
