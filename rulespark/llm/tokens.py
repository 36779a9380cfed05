"""Token ids of a byte-level BPE vocabulary file.

``tokenizer`` is a path of a tokenizers JSON file, or the name of one of the installed
public files; it is resolved where the worker runs. The ids are those that the
``tokenizers`` library gives with ``add_special_tokens=False``. Its vocabulary is run by
the ``tiktoken`` engine, about four times as fast; texts that hold the string of an added
token, or thousands of blanks in a row, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
#: The fast engine looks ahead in runs of blanks on a stack; longer runs go the other way.
LONG_BLANK = 2000
_BLANK = re.compile(r"\s{%d}" % LONG_BLANK)
#: The id that ends each document in a packed sequence.
END = 2


def resolve(tokenizer: str) -> str:
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, by its rule:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def encoder(tokenizer: str = TOKENIZER) -> Callable[[str], list[int]]:
    """text -> ids. Files that are not plain byte-level BPE run in ``tokenizers`` alone."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = resolve(tokenizer)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added = [t["content"] for t in spec["added_tokens"]]

    @lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def slow(text: str) -> list[int]:
        return exact().encode(text, add_special_tokens=False).ids

    pre, vocab = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab", {})
    plain = (
        spec["model"].get("type") == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and isinstance(vocab, dict)
    )
    if not plain:
        return slow
    import public_tokenizers
    import tiktoken

    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in added}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(a in text for a in added) or len(text) > LONG_BLANK and _BLANK.search(text):
            return slow(text)
        return fast.encode_ordinary(text)

    return encode


def document_ids(text: str | None, encode: Callable[[str], list[int]]) -> np.ndarray:
    """The ids of a document, then ``END``; a null text is an empty one."""
    ids = encode(text or "")
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = END
    return out


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []
