"""String helpers: key composition, fixed descriptions, whole-word term matching."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text shapes of the reference output that results must equal.
EVENT_DESCRIPTION_PREFIX = "GDELT Event "
EVENT_DESCRIPTION_MIDDLE = " between "
EVENT_DESCRIPTION_JOIN = " and "
EVENT_NODE_TYPE = "GeopoliticalEvent"
UNKNOWN_TYPE = "Unknown"
MISSING_CONTENT = "(No XML content)"

# Word character class used for word boundaries: letters, digits and underscore in
# the Unicode sense (the boundary rule of Python's ``re`` on ``str``).
WORD_CLASS = r"[\p{L}\p{N}_]"


def metric_key(metric_col: Column | str, metric_val: Column | str) -> Column:
    """``<column>_<value>`` key of the model."""
    return F.concat_ws("_", metric_col, metric_val)


def event_description(event_code: Column | str, a1: Column | str, a2: Column | str) -> Column:
    """Description text of an event node (F8)."""
    return F.concat(F.lit(EVENT_DESCRIPTION_PREFIX), F.col(event_code) if isinstance(event_code, str) else event_code,
                    F.lit(EVENT_DESCRIPTION_MIDDLE), F.col(a1) if isinstance(a1, str) else a1,
                    F.lit(EVENT_DESCRIPTION_JOIN), F.col(a2) if isinstance(a2, str) else a2)


def _is_word_char(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in ("L", "N")


def whole_word_pattern(term: str) -> str:
    """Java regex equal to ``\\b<escaped term>\\b`` with case folding.

    A ``\\b`` next to a word character means "no word character on the other side";
    next to a non-word character it means "a word character on the other side". Both are
    written as explicit look-arounds over the Unicode word class so the result does not
    depend on the JDK's ASCII/Unicode ``\\b`` mode.
    """
    if not term:
        raise ValueError("empty term")
    left = f"(?<!{WORD_CLASS})" if _is_word_char(term[0]) else f"(?<={WORD_CLASS})"
    right = f"(?!{WORD_CLASS})" if _is_word_char(term[-1]) else f"(?={WORD_CLASS})"
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return f"(?iu){left}{quoted}{right}"


def whole_word_sql(col: str, term: str) -> str:
    """DuckDB (RE2) twin of :func:`whole_word_pattern` for terms that start and end
    with word characters (RE2 has no look-arounds)."""
    if not (_is_word_char(term[0]) and _is_word_char(term[-1])):
        raise ValueError("SQL form supports word-character boundaries only")
    body = "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in term)
    body = body.replace("'", "''")
    return (f"coalesce(regexp_matches({col}, '(^|[^\\p{{L}}\\p{{N}}_]){body}([^\\p{{L}}\\p{{N}}_]|$)', 'i'), false)")


def matches_whole_word(cols: list[str], term: str) -> Column:
    """OR of whole-word matches over several optional text columns; NULL counts as no match."""
    pat = whole_word_pattern(term)
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.col(c).rlike(pat), F.lit(False))
    return out
