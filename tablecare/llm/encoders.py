"""Byte-level BPE token ids of whole texts, as the tokenizer file's own library gives them.

``RankEncoder`` reads the vocabulary and the merges from the tokenizer's JSON file and runs them
on a faster engine. Its ids equal those of the ``tokenizers`` library as long as merge ranks and
ids have the same order and the character classes of both engines agree; the first is checked
when the file is loaded, the second holds up to U+024F, and texts with other characters go
through ``tokenizers`` itself. Added special tokens inside a text count as that library's default
has it: as their own ids. Other kinds of tokenizer files always go through ``tokenizers``.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

# Fixed value: the split pattern of byte-level BPE, with possessive repeats where they match alike.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BEYOND = re.compile("[^\\x00-\\u024f]")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class RankEncoder:
    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        ranks = self._ranks(spec)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        """Vocabulary as ranks, if this file is plain byte-level BPE whose ids follow its merges."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
        if not plain or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout"):
            return None
        letters = _byte_letters()
        try:
            ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        except KeyError:
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in pairs]
        return ranks if ids == list(range(256, 256 + len(ids))) and len(ranks) == 256 + len(ids) else None

    def ids(self, text: str) -> list[int]:
        if self.fast is None or (not text.isascii() and BEYOND.search(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        if not self.special or not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        out: list[int] = []
        for part in self.split.split(text):
            out += [self.special[part]] if part in self.special else self.fast.encode_ordinary(part)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> RankEncoder:
    """One encoder per file and worker process."""
    return RankEncoder(path)
