"""Token ids of a byte-level vocabulary file."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

_LONG_SPACE = re.compile(r"\s{5000}")


def default_vocabulary() -> str:
    """Where this machine keeps the public byte-level vocabulary; each executor asks for itself."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> dict[str, int]:
    """The printable sign that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as the tokenizers library gives them for the file with add_special_tokens=False.

    The same merges are run by tiktoken, which takes a quarter of the time, where the file is a plain byte-level BPE whose ids
    follow its merges; texts with very long runs of white space, and other files, go to tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._path, self._library, self._fast = path, Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        vocabulary, split = parts["model"].get("vocab"), parts.get("pre_tokenizer") or {}
        self.size = self._library.get_vocab_size()
        special = {t["content"]: t["id"] for t in parts.get("added_tokens", [])}
        plain = parts["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if plain and not parts.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in parts.get("added_tokens", [])):
            import public_tokenizers
            import tiktoken
            signs = _byte_signs()
            ranks = {bytes(signs[c] for c in token): i for token, i in vocabulary.items() if token not in special}
            self._fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self._fast is None or len(text) > 20_000 and _LONG_SPACE.search(text):
            return self._library.encode(text, add_special_tokens=False).ids
        return self._fast.encode(text, allowed_special="all")

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
