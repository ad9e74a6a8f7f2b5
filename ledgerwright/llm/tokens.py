"""Token ids of texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache, partial

import numpy as np

#: White space of the vocabulary's rule (Unicode's property).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 10_000  # white-space characters in a row that `tiktoken` is not given: its pattern goes back over each
_LONG_SPACE = re.compile(f"(?<![{SPACES}])[{SPACES}]{{{LONG_RUN},}}")


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a `tokenizers` file, which are found inside texts before anything else."""
    with open(json_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that look at their surroundings are not supported")
    return {t["content"]: t["id"] for t in added}


class Encoder:
    """Ids of whole texts, equal to those of the `tokenizers` file of the same vocabulary.

    The ranks form of the vocabulary is encoded by `tiktoken`, which takes a quarter of the
    time; the tests hold its ids against those of `byte_bpe_50k.json`. With `added`, the
    added tokens of that file are ids of their own wherever a text holds them, as by the
    defaults of `tokenizers`; without, they are text like any other. A vocabulary given by
    `ranks_path` has its `tokenizers` file beside it, with the suffix .json.
    """

    def __init__(self, ranks_path: str | None = None, added: bool = False):
        import public_tokenizers
        import tiktoken

        ranks_path = ranks_path or vocabulary_path("byte_bpe_50k.tiktoken")
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = public_tokenizers.PATTERN
        self.added = added_tokens(f"{os.path.splitext(ranks_path)[0]}.json") if added else {}
        encoding = tiktoken.Encoding("units", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=self.added)
        self._encode = partial(encoding.encode, allowed_special="all") if self.added else encoding.encode_ordinary
        self._piece = encoding._encode_single_piece
        #: The bytes of each id.
        self.tokens = [b""] * (max([*ranks.values(), *self.added.values()]) + 1)
        for token, number in ranks.items():
            self.tokens[number] = token
        for token, number in self.added.items():
            self.tokens[number] = token.encode()

    def ids(self, text: str | None) -> np.ndarray:
        """The ids as unsigned 32-bit integers; none for null or empty text."""
        if not text:
            return np.empty(0, np.uint32)
        runs = list(_LONG_SPACE.finditer(text)) if len(text) >= LONG_RUN else ()
        if not runs:
            return np.array(self._encode(text), np.uint32)
        # A run of white space is a piece of its own, but for its last character where a word follows.
        out, at = [], 0
        for run in runs:
            whole = run.end() == len(text) or any(text.startswith(t, run.end()) for t in self.added)
            end = run.end() if whole else run.end() - 1
            out += [np.array(self._encode(text[at:run.start()]), np.uint32), self.piece(text[run.start():end].encode())]
            at = end
        return np.concatenate([*out, np.array(self._encode(text[at:]), np.uint32)])

    def piece(self, raw: bytes) -> np.ndarray:
        """The ids of bytes that the rule does not split."""
        return np.array(self._piece(raw), np.uint32) if raw else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(ranks_path: str | None = None) -> Encoder:
    """One encoder a worker process, with the added tokens of the vocabulary."""
    return Encoder(ranks_path, added=True)
