"""Token ids of whole texts, with a cache of the parts that a vocabulary's pre-tokenizer makes."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Distinct parts that a worker remembers.
REMEMBERED = 700_000

# Below U+0100 lower case and NFC change one code point at a time, so a text of these can be parted before it is normalised.
_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: The pre-tokenizer's pattern, for code points below U+0100.
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Its whole pattern; where a vocabulary parts texts otherwise, every text goes through the library.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_loaded: dict[str, Callable] = {}


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary; every machine must have it there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes; it and its cache stay in the worker."""
    if path not in _loaded:
        _loaded[path] = _load(path)
    return _loaded[path]


def _load(path: str) -> Callable[[list[str]], list[bytes]]:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    parted = _KNOWN.replace("\\", "\\\\") in tokenizer.to_str() and "Lowercase" in repr(tokenizer.normalizer)
    known: dict[str, bytes] = {}

    def plain(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(parts: list[str]) -> None:
        if len(known) + len(parts) > REMEMBERED:
            known.clear()
        got = tokenizer.encode(" ".join(parts), add_special_tokens=False)
        word = np.array(got.word_ids, dtype=np.int64)
        raw = np.array(got.ids, dtype="<u4").tobytes()
        cuts = [0, *(4 * (np.flatnonzero(np.diff(word)) + 1)).tolist(), len(raw)]
        if len(cuts) != len(parts) + 1:
            known.update((p, plain(p)) for p in parts)
        else:
            known.update((p, raw[a:b]) for p, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True))

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if not parted or (not text.isascii() and max(text) > "ÿ") or any(s in text for s in special):
                out.append(plain(text))
                continue
            parts = _PART.findall(text.lower())
            if new := list(set(parts).difference(known)):
                kept = len(known)
                learn(new)
                if len(known) < kept + len(new):  # it was cleared
                    if new := list(set(parts).difference(known)):
                        learn(new)
            try:
                out.append(b"".join(map(known.__getitem__, parts)))
            except KeyError:  # a text with more distinct parts than are remembered
                out.append(plain(text))
        return out

    return encode
