"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def chunks(texts: list[str], together: int) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) in runs of about ``together`` characters, which bounds memory; a longer text is alone."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > together:
            yield start, texts[start:k]
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def ngram_buckets(texts: list[str], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket (of 2 ** bits) of every n-gram within a text, and its text. A NUL parts texts."""
    points = np.frombuffer("".join(f" {t.lower().replace(chr(0), ' ')} \0" for t in texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.cumsum(np.concatenate(([0], points[:-1] == 0)), dtype=np.int64)
    value = points * np.uint32(2654435761)
    for n in range(1, max(orders) + 1):
        if n > 1:
            value = value[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :] * np.uint32(0x85EBCA77)
            value ^= value >> np.uint32(15)
        if n in orders and len(value):
            inside = np.append(owner[n : n + len(value) - 1] == owner[: len(value) - 1], False)  # no NUL, so no other text
            yield ((value[inside] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - bits)), owner[: len(value)][inside]
