"""Response windows over a sub-word tokenizer (E5 with its re-encoding check).

With white-space tokens a window always re-encodes to itself. With sub-words it need not: the text
of some tokens, cut out of their surroundings, may encode to more or fewer tokens. A window is
accepted only if its text encodes to exactly as many tokens as were cut out.

The tokenizer is a file of a public vocabulary; its path is a parameter.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marksmith.operators.pairing import WINDOW_MAX_OFFSET, WINDOW_TRIES

WHOLE = -1


@functools.lru_cache(maxsize=2)
def _tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(file)


def accepted_window(ids: list[int], width: int, used: set[str], tok) -> tuple[int, str] | None:
    """``(start, text)`` of the first of WINDOW_TRIES successive windows of ``width`` tokens whose
    text encodes to ``width`` tokens again and is not in ``used``."""
    first = min(WINDOW_MAX_OFFSET, len(ids) - width)
    for start in range(max(first, 0), first + WINDOW_TRIES):
        if first < 0 or start + width > len(ids):
            return None
        text = tok.decode(ids[start:start + width], skip_special_tokens=False)
        if text not in used and len(tok.encode(text, add_special_tokens=False).ids) == width:
            return start, text
    return None


def row_windows(texts: list[str | None], width: int, tok) -> list[tuple[int, str, int, int]]:
    """``(sig, response, start, n_tokens)`` of one row; its equal texts are encoded once, without
    offsets, which nothing here reads."""
    used: set[str] = set()
    encoded: dict[str, list[int]] = {}
    rows = []
    for sig, text in enumerate(text or "" for text in texts):
        if text not in encoded:
            encoded[text] = tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = encoded[text]
        start, chosen = accepted_window(ids, width, used, tok) or (WHOLE, text)
        used.add(chosen)
        rows.append((sig, chosen, start, len(ids) if start == WHOLE else width))
    return rows


def encoded_windows(df: DataFrame, row_id: str, responses: Column, width: int, file: str) -> DataFrame:
    """``(row_id, sig, response, start, n_tokens)``: for each text of the array ``responses`` its
    accepted window, or the whole text (start WHOLE) where no window is. Windows of one row are
    distinct. A null text is the empty text, a null array has no rows."""
    schema = T.StructType([df.schema[row_id], *T.StructType.fromDDL(
        "sig int, response string, start int, n_tokens long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(file)
        for batch in batches:
            rows = []
            for key, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(key, *window) for window in row_windows(texts or [], width, tok)]
            cols = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(row_id, responses.alias("_texts")).mapInArrow(run, schema)
