"""Ids of a byte-level BPE tokenizer file, exactly as the tokenizers library gives them.

Where the order of the file's merges is the order of their ids, and the pre-tokenisation is the
library's own byte-level pattern without a normaliser, the same vocabulary can be run by
tiktoken, which takes a fraction of the time. A text that holds an added token's string or that
is very long (or odd enough for tiktoken to fail) goes through the tokenizers library, as does
every text of a file for which that proof fails.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

#: The pattern of the byte-level pre-tokeniser (fixed value).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts with more characters are encoded by the tokenizers library, whose time per long word
#: without white space grows more slowly.
LONG_CHARS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1),
             *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """``plain`` reads the strings of added tokens inside texts as ordinary text; otherwise they
    are the added tokens, the library's default."""

    def __init__(self, file: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(file)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = plain
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = () if plain else tuple(added)
        vocab = spec["model"]["vocab"]
        #: bytes of each id
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()
                         if all(c in alphabet for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in added.items() if t not in vocab}
        self.fast = self._fast(spec, vocab, plain)

    def _fast(self, spec: dict, vocab: dict, plain: bool):
        pre = spec["pre_tokenizer"] or {}
        model = spec["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocab.get(m, -1) for m in merged]
        same_order = all(a < b for a, b in zip(ids, ids[1:]))
        complete = len(vocab) == 256 + len(merged) and (not ids or ids[0] == 256)
        usual = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and spec["normalizer"] is None
                 and model["type"] == "BPE" and not model.get("ignore_merges")
                 and not any(t["lstrip"] or t["rstrip"] or t["single_word"]
                             for t in spec["added_tokens"]))
        if not (same_order and complete and usual):
            return None
        import tiktoken
        ranks = {self.bytes_of[i]: i for i in vocab.values() if i in self.bytes_of}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text, without special tokens of the library's own."""
        if self.fast is not None and len(text) <= LONG_CHARS and not any(
                m in text for m in self.marks):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
            except BaseException as e:  # tiktoken's pattern engine panics, which is no Exception
                if type(e).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                    raise
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def byte_bpe(file: str, plain: bool = False) -> ByteBpe:
    return ByteBpe(file, plain)


def default_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
