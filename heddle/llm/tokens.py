"""Token counts of a public byte-level BPE vocabulary.

The vocabulary file is a parameter and is read on the worker; it is never part
of this repository.
"""

from __future__ import annotations

import base64
from functools import lru_cache

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the vocabulary is unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):  # noqa: ANN201
    """The tokenizer of a rank file, read once in a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    """Tokens of ``text``."""
    return len(encoding(path).encode_ordinary(text))
