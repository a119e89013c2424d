"""Text cleaning and id expressions, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The separator between the columns of a record text, and the
# characters cleaning keeps (letters, numbers, underscore) or treats as space.
SEPARATOR = " [SEP] "
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
DROPPED_PATTERN = rf"[^\p{{L}}\p{{N}}_{SPACE}]"
SPACE_PATTERN = rf"[{SPACE}]+"


def clean(text: Column) -> Column:
    """Lower-case, drop punctuation, squeeze white space, trim; null becomes ''."""
    kept = F.regexp_replace(F.lower(text), DROPPED_PATTERN, "")
    squeezed = F.regexp_replace(kept, SPACE_PATTERN, " ")
    return F.coalesce(F.trim(squeezed), F.lit(""))


def record_text(columns: Sequence[str]) -> Column:
    """Join columns to one string; an empty column still leaves its separator."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def numeric_id(raw: str) -> Column:
    """Ids such as '12', '12.0' or ' 12' as BIGINT, anything else as null."""
    return F.expr(f"try_cast(try_cast(`{raw}` AS DOUBLE) AS BIGINT)")


def canonical_id(raw: str, numeric: bool = False) -> Column:
    """The one string form in which ids are compared."""
    return numeric_id(raw).cast("string") if numeric else F.trim(F.col(raw).cast("string"))


def shuffle_key(columns: Sequence[str], seed: int) -> Column:
    """A reproducible shuffle key: md5 over the row key and the seed."""
    return F.md5(F.concat_ws("#", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))
