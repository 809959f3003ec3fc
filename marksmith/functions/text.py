"""Whitespace-token text functions (the engine's tokenizer).

A token is a maximal run of non-whitespace characters; decoding joins tokens
with one space. Re-encoding a decoded window therefore gives the same tokens,
which makes the response-window rule exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved token strings and their ids (unknown, begin, end of
# sequence), the layout of common causal language-model vocabularies.
UNK = "<unk>"
BOS = "<s>"
EOS = "</s>"
RESERVED = {UNK: 0, BOS: 1, EOS: 2}
IGNORE_INDEX = -100

# Keeps letters, digits (any script) and the plain space; everything else,
# newlines and tabs included, is removed.
PUNCT_PATTERN = r"[^\p{L}\p{N} ]"


def tokens(text) -> Column:
    """Whitespace tokens. ``split`` on runs of whitespace yields empty strings only
    at the ends, so removing them equals filtering; ``array_remove`` (unlike a
    lambda) takes part in common-subexpression elimination, so a text referenced
    several times in one projection is split once."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(text, r"\s+"), "")


def leading_tokens(text, n: int) -> Column:
    """The first ``n`` of ``tokens``, and more where there are more, without splitting a long text to
    its end: one of the ``n + 2`` parts may be an empty one in front, the last one is the rest."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(text, r"\s+", n + 2), "")


def has_token_after_strip(text, whitespace_to_space: bool = False) -> Column:
    """True iff ``tokens(strip_punct(text))`` is non-empty: stripping keeps only
    letters, digits and spaces, so a letter or digit must be present. A cheap
    test on the raw text (a filter on it may be pushed into the scan)."""
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(r"[\p{L}\p{N}]")


def has_token(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(r"\S")


def strip_punct(text, whitespace_to_space: bool = False) -> Column:
    """Keep letters, digits and spaces. Newlines and tabs are removed too, so
    the words around them merge (the default); ``whitespace_to_space`` maps every
    whitespace character to a space first."""
    text = F.col(text) if isinstance(text, str) else text
    if whitespace_to_space:
        text = F.regexp_replace(text, r"\s", " ")
    return F.regexp_replace(text, PUNCT_PATTERN, "")


def decode_tokens(arr) -> Column:
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(arr, " ")


def window_start(n_tokens: Column, width: int, max_offset: int = 10) -> Column:
    """0-based start of the response window: ``min(max_offset, L - width)``."""
    return F.least(F.lit(max_offset), n_tokens - F.lit(width))
