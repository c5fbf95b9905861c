"""Token ids of a public byte-level BPE vocabulary, the same as its tokenizer library gives, in bounded batches."""

from __future__ import annotations

import base64
import hashlib
import os
import re

#: Characters for which both libraries split words alike whatever their Unicode tables' age. A text with any other
#: character, or with a special token's string, goes to the tokenizer itself.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧€]*")
_LOADED: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(path: str) -> str:
    """A tokenizer's version: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Encoder:
    """``ids(text)`` as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    ``ranks`` is a file of the same vocabulary for a faster library, used only for texts within PLAIN.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One encoder for each worker process."""
    key = f"{path}|{ranks}"
    if key not in _LOADED:
        _LOADED[key] = Encoder(path, ranks)
    return _LOADED[key]
