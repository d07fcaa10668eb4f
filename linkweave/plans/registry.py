"""Where the catalogue's modules enter their queries and the SQL that says what they return."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None):
    def keep(f):
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


def rounded(c, digits: int):
    """Rounded as SQL's round does it: a zero keeps the sign of what was rounded, which F.round drops."""
    out = F.round(c, digits)
    return F.when(out == 0, F.signum(c) * 0.0).otherwise(out)


#: Sums of path weights are often exact ties at the sixth digit up to an error of the last bit; both sides lift them off it.
LIFT = "1.00000000037"


def r6w(c):
    return F.round(F.col(c) * float(LIFT), 6)
