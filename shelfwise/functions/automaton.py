"""Many words looked for at once: an Aho-Corasick automaton as a table of transitions, walked once over each text whatever the number of words."""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters walked at a time; longer texts are cut into overlapping stretches.
STRETCH = 512
#: Characters held at a time as numbers, whatever the size of a batch or of a text.
BLOCK = 1 << 20
#: Words from which `rules.first_rule` takes the automaton instead of a CASE.
MANY_WORDS = 200


class Automaton:
    """States by characters (as classes of the words' alphabet), and for each state the least place of the words that end there.

    The table has a row for each prefix of a word and a column for each character that words use: 6,000 words of 15 letters take about 15 MB.
    """

    def __init__(self, words: tuple[str, ...]):
        self.alphabet = np.array(sorted({ord(ch) for w in words for ch in w}), dtype=np.uint32)
        code = {int(ch): i + 1 for i, ch in enumerate(self.alphabet)}
        children: list[dict[int, int]] = [{}]
        place = [len(words)]
        for i, word in enumerate(words):
            state = 0
            for ch in word:
                state = children[state].setdefault(code[ord(ch)], len(children))
                if state == len(children):
                    children.append({})
                    place.append(len(words))
            place[state] = min(place[state], i)
        self.table = np.zeros((len(children), len(code) + 1), dtype=np.int32)
        self.place = np.array(place, dtype=np.int64)
        self.reach = max([len(w) - 1 for w in words if w], default=0)
        waiting, back = deque([0]), [0] * len(children)
        while waiting:
            state = waiting.popleft()
            if state:
                self.table[state] = self.table[back[state]]
                self.place[state] = min(self.place[state], self.place[back[state]])
            for ch, child in children[state].items():
                back[child] = int(self.table[state, ch]) if state else 0
                self.table[state, ch] = child
                waiting.append(child)

    def first(self, texts: list[str | None]) -> np.ndarray:
        """The place of the first word that each text contains; the number of words where it has none or is null. Works on BLOCK characters at a time."""
        best = np.full(len(texts), self.place[0], dtype=np.int64)
        rows, parts, held = [], [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text or ""), BLOCK):
                rows.append(i)
                parts.append(text[at : at + BLOCK + self.reach])
                held += len(parts[-1])
                if held >= BLOCK:
                    np.minimum.at(best, rows, self._walk(parts))
                    rows, parts, held = [], [], 0
        if parts:
            np.minimum.at(best, rows, self._walk(parts))
        return best

    def _walk(self, texts: list[str]) -> np.ndarray:
        """`first` of texts that are not empty, all at once: one step for each character of a stretch, over all stretches that are as long."""
        best = np.full(len(texts), self.place[0], dtype=np.int64)
        if not len(self.alphabet):
            return best
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        classes = np.where(self.alphabet[at] == chars, at + 1, 0).astype(np.int32)
        # Stretches begin STRETCH apart and reach as far into the next one as a word can.
        pieces = -(-lengths // STRETCH)
        row = np.repeat(np.arange(len(texts)), pieces)
        inside = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        begin = (np.cumsum(lengths) - lengths)[row] + inside
        size = np.minimum(lengths[row] - inside, STRETCH + self.reach)
        order = np.argsort(-size, kind="stable")
        begin, size, row = begin[order], size[order], row[order]
        state, found = np.zeros(len(row), dtype=np.int32), np.full(len(row), self.place[0], dtype=np.int64)
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for step in range(int(size[0])):
            n = active[step]
            state[:n] = self.table[state[:n], classes[begin[:n] + step]]
            np.minimum(found[:n], self.place[state[:n]], out=found[:n])
        np.minimum.at(best, row, found)
        return best


@functools.lru_cache(maxsize=8)
def automaton(words: tuple[str, ...]) -> Automaton:
    return Automaton(words)


def first_word(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule whose word the text contains, as `rules.first_rule`; null texts get the default, an empty word is in every other text.

    Only the words go to the tasks; each worker builds the table once.
    """
    words = tuple(w for w, _ in rules)
    values = np.array([*(v for _, v in rules), default], dtype=object)

    @F.arrow_udf("string")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = automaton(words)
        for batch in batches:
            yield pa.concat_arrays([pa.array([], pa.string()), *[place(found, part.to_pylist()) for part in slices(batch)]])

    def place(found: Automaton, texts: list[str | None]) -> pa.Array:
        out = values[found.first(texts)]
        out[[t is None for t in texts]] = default
        return pa.array(out, pa.string())

    return look_up(text)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Stretches of a batch, a text and what follows it in fewer than BLOCK bytes: only one of them becomes Python strings at a time."""
    group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK
    ends = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip([0, *ends], ends):
        if b > a:
            yield texts.slice(a, b - a)
