"""Column-level helpers: keyed randomness and whitespace-token text functions."""

from marksmith.functions.keyed import bucket, unit_draw
from marksmith.functions.text import (
    BOS, EOS, UNK, RESERVED, decode_tokens, strip_punct, tokens, window_start,
)

__all__ = [
    "bucket", "unit_draw", "BOS", "EOS", "UNK", "RESERVED", "decode_tokens",
    "strip_punct", "tokens", "window_start",
]
