"""Token ids of a public byte-level BPE vocabulary, computed inside tasks."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: The vocabulary whose ids are wanted, and the same vocabulary as ranks, which encodes faster.
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: A text that holds this string is encoded by the vocabulary file itself, which has an id of its own for it.
SPECIAL = "<|endoftext|>"

#: Vocabulary file and ranks of tokenizer versions; other names are labels of the first.
VERSIONS = {"byte_bpe_50k": (VOCABULARY, RANKS), "byte_bpe_multi_50k": (None, "byte_bpe_multi_50k.tiktoken")}


def encoder_of(version: str):
    """The encoder of a tokenizer version."""
    return encoder(*VERSIONS.get(version, (VOCABULARY, RANKS)))


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None = VOCABULARY, ranks: str = RANKS):
    """A function from text to uint32 ids, made once per Python worker.  Without a vocabulary file no string is special."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    slow = []

    def encode(text: str) -> np.ndarray:
        if vocabulary and SPECIAL in text:
            if not slow:
                from tokenizers import Tokenizer
                slow.append(Tokenizer.from_file(public_tokenizers.path(vocabulary)))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode
