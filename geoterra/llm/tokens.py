"""Byte-level BPE ids inside tasks, from vocabulary files whose path is a parameter."""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np

#: The pre-tokenisation pattern of the 50k byte-level vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary as ranks, which encodes ordinary text about four times as fast; None if there is no such file."""
    import tiktoken

    ranks_file = Path(path).with_suffix(".tiktoken")
    if not ranks_file.exists():
        return None
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.read_bytes().splitlines())}
    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = PATTERN
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def width(path: str, *more: int) -> np.dtype:
    """The smallest of the two id types that holds every id of the vocabulary, and the ids in ``more``."""
    top = max(_exact(path).get_vocab_size(with_added_tokens=True) - 1, *more)
    return np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")


def encode(text: str | None, path: str, special: bool = True) -> np.ndarray:
    """Ids of the whole text, as the ``tokenizers`` file at ``path`` gives them without added special tokens.

    Strings of special tokens in the text are those tokens, or ordinary text without ``special``. The rank file gives up
    on white space of more than some 500,000 characters in a row; such texts go through ``tokenizers``.
    """
    if not text:
        return np.zeros(0, np.uint32)
    fast = _fast(path)
    if fast is not None and not (special and SPECIAL in text):
        try:
            return np.asarray(fast.encode_to_numpy(text), np.uint32)
        except ValueError:
            pass
    exact = _exact(path)
    exact.encode_special_tokens = not special
    return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)
