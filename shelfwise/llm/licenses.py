"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Templates are cut into words (lower case, letters and digits). Hashes of their k-word grams are winnowed (the least of every window of
w); a template whose matches may have no run of k + w - 1 words keeps all grams, of fewer words if need be (`TemplateIndex`). The inverted
index maps each kept hash to its templates and positions; it is bounded by the templates and sent to every task. A document looks up all of its grams; hits of one template on nearby diagonals make a candidate window, and a banded sequence
alignment of window and template gives the matched words. Windows that match are aligned again without the words of the matches
found, until none matches. A match is reported if enough of the template is covered, with its
span in code points.

Cases: null and empty texts match nothing; repeated rows are scanned again; of overlapping matches the one with more matched words
stays (ties: the earlier, then the lesser template name); a license that stands in a text several times is reported as often; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import table
from shelfwise.llm.license_texts import NOTICES, TEXTS

#: Words of a gram, grams of a winnowing window, least half width of the band, least share of the template that must match.
GRAM, WINDOW, BAND, COVERAGE = 4, 3, 8, 0.8
_WORD = re.compile(r"[^\W_]+")
#: Stands for a word that a match has.
_TAKEN = -2

TEMPLATES = NOTICES | TEXTS


def words(text: str) -> list[str]:
    """The words in lower case; as many as in the text as it stands."""
    low = text.lower()
    # Letters that grow in lower case (a dotted capital i) would fall apart.
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def gram_hash(gram: tuple[str, ...]) -> int:
    return zlib.crc32("\x1f".join(gram).encode("utf-8", "surrogatepass"))


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Positions of the least hash (the last of equals) of every window."""
    if len(hashes) <= window:
        return sorted({min(range(len(hashes)), key=lambda i: (hashes[i], -i))}) if hashes else []
    return sorted({min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)})


class TemplateIndex:
    """The inverted index: word gram hash -> [(template, position)], and the words of each template."""

    def __init__(self, templates: dict[str, str], k: int = GRAM, window: int = WINDOW, coverage: float = COVERAGE):
        self.k, self.names = k, sorted(templates)
        self.words = [words(templates[n]) for n in self.names]
        self.post: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sizes: set[int] = set()
        for t, ws in enumerate(self.words):
            # Of a match with `missing` words of the template replaced, the longest run without one has at least `run` words.
            missing = int((1 - coverage) * len(ws) + 1e-9)
            run = -(-(len(ws) - missing) // (missing + 1))
            size = min(k, run)
            if size:
                self.sizes.add(size)
                hashes = [gram_hash(tuple(ws[i : i + size])) for i in range(len(ws) - size + 1)]
                for i in winnow(hashes, window) if run >= size + window - 1 else range(len(hashes)):
                    self.post[hashes[i]].append((t, i))
        self.vocabulary = {w for ws in self.words for w in ws}
        self.number = {w: i for i, w in enumerate(sorted(self.vocabulary))}
        self.ids = [np.array([self.number[w] for w in ws], np.int64) for ws in self.words]
        self.counts = [np.bincount(x, minlength=len(self.number)) for x in self.ids]

    def shared(self, t: int, window: np.ndarray) -> int:
        """Words of template t that the window has, each as often as in both: no alignment matches more."""
        return int(np.minimum(self.counts[t], np.bincount(window[window >= 0], minlength=len(self.number))).sum())


#: A cell of the table as one number that sorts: words matched, then a late first word (so that what goes on from the cell has a short span), then
#: an early last one; 21 bits for either place.
_PLACE = (1 << 21) - 1
#: Windows that are aligned together.
STACK = 64


def align_all(windows: list[np.ndarray], shifts: list[int], template: np.ndarray, band: int) -> list[tuple[int, int, int]]:
    """(matched words, first, last) of the best alignment of `template` in each window on diagonals within `band` of its shift.

    Words are numbers; those of no template are negative. One numpy row for each template word, over all windows: a cell is the best of the
    cells left, above and left above, and of the match that goes on from there.
    """
    out: list[tuple[int, int, int]] = []
    for at in range(0, len(windows), STACK):
        part = windows[at : at + STACK]
        n = max(map(len, part))
        ids = np.full((len(part), n), -1)
        for row, w in zip(ids, part):
            row[: len(w)] = w
        place = np.arange(n)
        low = np.array(shifts[at : at + STACK])[:, None] - band
        best, diagonal = np.zeros((len(part), n), np.int64), np.zeros((len(part), n), np.int64)
        for i, word in enumerate(template):
            inside = (place >= low + i) & (place <= low + i + 2 * band)
            a, b = max(0, int(low.min()) + i), min(n, int(low.max()) + i + 2 * band + 1)
            if a >= b:
                continue
            diagonal[:, 1:] = best[:, :-1]
            d, p = diagonal[:, a:b], place[a:b]
            first = np.where(d > 0, (d >> 21) & _PLACE, p)
            going = (((d >> 42) + 1) << 42) | (first << 21) | (_PLACE - p)
            now = np.maximum(np.maximum(best[:, a:b], d), np.where(ids[:, a:b] == word, going, 0))
            # Cells outside the band of their window stay as they are, and nothing comes from them.
            within = inside[:, a:b]
            now = np.maximum.accumulate(np.where(within, now, 0), axis=1)
            best[:, a:b] = np.where(within, now, best[:, a:b])
        matched, first, last = best >> 42, (best >> 21) & _PLACE, _PLACE - (best & _PLACE)
        for m, f, e in zip(matched, first, last):
            at_most = np.flatnonzero(m == m.max()) if m.any() else ()
            x = min(at_most, key=lambda x: (e[x] - f[x], f[x]), default=None)  # noqa: B023
            out.append((0, -1, -1) if x is None else (int(m[x]), int(f[x]), int(e[x])))
    return out


def align(window: list[str], template: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """align_all for one window of words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(template))}
    return align_all([np.array([number.get(w, -1) for w in window], np.int64)], [shift], np.array([number[w] for w in template], np.int64), band)[0]


def scan(text: str, index: TemplateIndex, coverage: float = COVERAGE, band: int = BAND) -> list[tuple[str, float, int, int]]:
    """(template, covered share, start, end) of every match, in order."""
    ws = words(text)
    ids = np.fromiter((index.number.get(w, -1) for w in ws), np.int64, len(ws))
    known = ids >= 0
    hits: dict[int, list[int]] = defaultdict(list)
    for size in index.sizes:
        if len(ws) < size:
            continue
        run = known[: len(ws) - size + 1].copy()
        for o in range(1, size):
            run &= known[o : len(ws) - size + 1 + o]
        for i in np.flatnonzero(run).tolist():
            for t, p in index.post.get(gram_hash(tuple(ws[i : i + size])), ()):
                hits[t].append(i - p)
    if not hits:
        return []
    found, out = [m.span() for m in _WORD.finditer(text)], []
    for t, places in hits.items():
        template, need = index.ids[t], coverage * len(index.ids[t])
        # As many words as a match may leave out, its diagonals may be apart.
        wide = max(band, len(template) - math.ceil(need))
        starts = np.unique(places)
        edges = np.flatnonzero(np.diff(starts) > wide) + 1
        left, bases = ids.copy(), []
        for group in np.split(starts, edges):
            bases += [(base, int(group[-1])) for base in range(int(group[0]), int(group[-1]) + 1, 2 * wide + 1)]
        while bases:
            windows, shifts, owners = [], [], []
            for base, end in bases:
                a, b = max(0, base - wide), min(len(ws), base + len(template) + 3 * wide)
                cuts = [a - 1, *(np.flatnonzero(left[a:b] == _TAKEN) + a).tolist(), b]
                for c, d in zip(cuts, cuts[1:]):
                    if d - c - 1 >= need and index.shared(t, left[c + 1 : d]) >= need:
                        windows.append(left[c + 1 : d])
                        shifts.append(base + min(wide, end - base) - c - 1)
                        owners.append((base, end, c + 1))
            again, matches = [], set()
            for (base, end, c), (matched, first, last) in zip(owners, align_all(windows, shifts, template, 2 * wide)):
                if matched >= need:
                    matches.add((-matched, c + first, c + last))
                    again.append((base, end))
            for matched, first, last in sorted(matches):
                if (left[first : last + 1] != _TAKEN).all():
                    left[first : last + 1] = _TAKEN
                    out.append((-matched, found[first][0], found[last][1], t))
            bases = list(dict.fromkeys(again))
    chosen: list[tuple[int, int, int, int]] = []
    for matched, a, b, t in sorted(out, key=lambda m: (-m[0], m[1], m[3])):
        # Those chosen don't overlap, so only the neighbours of the place can.
        at = bisect.bisect_left(chosen, (a,))
        if (not at or chosen[at - 1][1] <= a) and (at == len(chosen) or b <= chosen[at][0]):
            chosen.insert(at, (a, b, matched, t))
    return [(index.names[t], matched / len(index.words[t]), a, b) for a, b, matched, t in chosen]


def find(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, license, coverage, span_start, span_end), a row for each match."""
    index = TemplateIndex(templates or TEMPLATES, coverage=coverage)

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *m) for i, x in zip(part["id"], part["text"]) if x for m in scan(x, index, coverage)]
            yield pd.DataFrame(rows, columns=["id", "license", "coverage", "span_start", "span_end"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(batch, f"id {id_type}, license string, coverage double, span_start long, span_end long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
