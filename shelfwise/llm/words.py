r"""Numbers for the words of many texts, and names of repeated stretches of them; shared by operators on words.

Words are `[^\x20\x09-\x0D]+`: what bytes.split() gives for UTF-8. All arrays are as long as the words of a slice of texts, whatever the table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Bytes of text that are worked on together; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most `limit` bytes, or of one text."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def numbered(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, number of the list) for all words of all lists in order; equal words of any list have one number."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
    return ids, np.repeat(np.arange(len(parts)), counts)


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys that are not negative; key and place are sorted as one number where both fit."""
    bits = int(len(keys)).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits > 62:
        return np.argsort(keys, kind="stable")
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def repeated(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, groups): the ascending places of every key that occurs twice or more, one key after the other, and its group from 0."""
    if not len(places):
        return places, places
    order = stable_order(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.flatnonzero(new)
    often = np.diff(np.append(starts, len(ordered))) > 1
    group = np.cumsum(new) - 1
    kept = often[group]
    return places[order][kept], (np.cumsum(often) - 1)[group[kept]]


def names(n: int, places: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A name for each of n places: its group, -1 where what begins there does not occur again."""
    out = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    out[places] = groups
    return out


def word_names(ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Names of the words that occur again in the same text; other texts have other names."""
    places, groups = repeated(np.arange(len(ids)), owner * (int(ids.max()) + 1 if len(ids) else 1) + ids)
    return names(len(ids), places, groups)


def pair_places(named: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """`repeated` for the stretches made of two named ones, the second `step` further on."""
    at = np.flatnonzero(named[: max(len(named) - step, 0)] >= 0)
    at = at[named[at + step] >= 0]
    return repeated(at, named[at].astype(np.int64) * (int(named.max()) + 1 if len(named) else 1) + named[at + step])
