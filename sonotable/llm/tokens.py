"""Token ids of whole texts, equal to those of the ``tokenizers`` library.

A tokenizer file of a plain byte-level BPE (merges in the order of their ids, no normaliser,
the usual cut into words) is loaded by ``tokenizers`` for what it holds, and its vocabulary
is handed to ``tiktoken`` as ranks: both libraries then give the same ids, and the second
takes half the time. Texts in which an added token's own string occurs, texts that are not
valid Unicode, and all texts of tokenizer files of another kind go through ``tokenizers``
itself. tests/llm/test_llm_tokens.py compares both over all of Unicode, over special strings
and over the whole vocabulary.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# The word pattern of this family, with possessive repeats (they match the same)
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_of() -> dict[str, int]:
    """The byte that a character of the vocabulary stands for: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """Bytes to id of a tokenizer file's vocabulary, or None if the file is of another kind."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
             and not cut.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    if not plain:
        return None
    vocab, letters = model["vocab"], byte_of()
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab.get(m) for m in made] != list(range(256, 256 + len(made))):
        return None
    return {bytes(map(letters.__getitem__, token)): i for token, i in vocab.items() if all(c in letters for c in token)}


class Coder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        ranks = ranks_of(spec)
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text`` as little-endian unsigned 16-bit numbers."""
        if self.fast is not None and not self.added.search(text):
            try:
                return self.fast.encode_to_numpy(text).astype("<u2")
            except UnicodeEncodeError:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2")


_CODERS: dict[str, Coder] = {}


def coder(tokenizer: str) -> Coder:
    """The worker's coder for a tokenizer file: a path, or the name of a file of ``public_tokenizers``."""
    if tokenizer not in _CODERS:
        path = tokenizer
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _CODERS[tokenizer] = Coder(path)
    return _CODERS[tokenizer]
