"""Ids of texts by a byte-level BPE tokenizers file."""

from __future__ import annotations

import json
import os

#: Fixed value: the pre-token pattern of byte-level files that keep the library's own (``use_regex``).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> dict[int, str]:
    """The character of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class ByteLevel:
    """A tokenizers file. ``special``: strings of added tokens inside a text are those tokens, else plain text.

    Where the file is plain byte-level BPE whose ids follow its merges, texts are encoded by the rank form of the same
    vocabulary, which gives the same ids in a quarter of the time; other files, and texts with an added token, go
    through the file's tokenizer.
    """

    def __init__(self, path: str, special: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.ranked = self._rank_form(json.loads(self.tokenizer.to_str()))

    def _rank_form(self, spec: dict):
        pre, model, chars = spec["pre_tokenizer"] or {}, spec["model"], {c: b for b, c in byte_chars().items()}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            return None
        vocabulary = model["vocab"]
        if any(c not in chars for t in vocabulary for c in t):
            return None
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in merged or merged != sorted(merged):
            return None
        import tiktoken

        ranks = {bytes(chars[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.ranked is None or any(t in text for t in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)
