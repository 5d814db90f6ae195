"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is a public merge-type (BPE) model, given by path. A space is put in front of a text, and the agenda takes the pair of
neighbours whose joined piece ranks first, leftmost on ties, until none is left. With dropout every candidate that the agenda takes is
skipped if its own keyed hash, of (seed, document id, epoch, number of the word, place in the word, rank), falls below the rate; a
skipped candidate is gone until one of its sides changes. Equal calls give equal pieces, whatever the batches.

No piece holds a space behind another character, and characters that are in no longer piece join with nothing: texts are cut there without
changing the result. The words of a slice go through the agenda together in numpy: a state is a word with the decisions made so far, every
round takes the best candidate of every state, decides it for every occurrence by itself, and makes the states that were reached. Nothing is
remembered from slice to slice. Characters outside the vocabulary, and a U+2581 of the text itself, become byte pieces, so decoding
returns every text exactly.

Cases: null text encodes to null, empty text to no pieces; without dropout the result is the public library's; repeated rows with one
id and epoch have one segmentation, null ids share a key, null epochs count as 0; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
DROPOUT, SEED = 0.1, 42
#: Characters that are encoded together; lengths of words that share a table of states (longer words go one by one).
TOGETHER, WIDTHS = 1 << 21, (8, 16, 64)
NONE = np.int32((1 << 31) - 1)
_M = (1 << 64) - 1
_STRIDE, _PLACE, _RANK = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7


def scattered(h):
    """A bijective hash of 64-bit numbers: of an array, or of an int."""
    if isinstance(h, int):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _M
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _M
        return h ^ (h >> 31)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_key(seed: int, key: int, epoch: int = 0) -> int:
    """The hash that a text's decisions start from."""
    return scattered((scattered((scattered(seed & _M) ^ key) & _M) + epoch * _STRIDE) & _M)


class Numbers(dict):
    """Word -> its number among the words seen."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of piece ids in one array, and how many each has."""
    return np.array(list(chain.from_iterable(lists)), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))


class Pieces:
    """Encoder and decoder over one model file."""

    def __init__(self, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, merges: int | None = None):
        """`merges` keeps the first so many pieces of two characters or more: an earlier state of the vocabulary."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.piece) if sp.is_byte(i)}
        self.of_byte = {b: i for i, b in byte_of.items()}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        plain = {i: self.piece[i].replace(SPACE, " ") for i in normal}
        self.ids = {p: i for i, p in plain.items()}
        place = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i, p in plain.items() if len(p) > 1}))}
        self.rank = {p: place[-sp.get_score(i)] for i, p in plain.items() if len(p) > 1 and (merges is None or place[-sp.get_score(i)] < merges)}
        joining = {c for p in self.rank for c in p if c != " "}
        letters = "".join(re.escape(c) for c in sorted(joining))
        self.units = re.compile(f" *[{letters}]+| +|[^ {letters}]")
        self.seed, self.threshold = seed, int(dropout * 2**53)
        self.bytes_of = [bytes([byte_of[i]]) if i in byte_of else plain.get(i, p).encode("utf-8", "surrogatepass") for i, p in enumerate(self.piece)]
        self._tables()

    def _tables(self) -> None:
        """Numpy tables: code point -> piece, (left piece, right piece) -> rank and joined piece, rank -> piece, piece -> its bytes."""
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        pairs = [(self.ids[p[:k]] << 20 | self.ids[p[k:]], r, self.ids[p]) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self._hash_table(np.array(pairs or [(-2, 0, 0)], np.int64))
        # Runs of spaces share a rank: there only the pair tells the piece.
        self.of_rank = np.full(max(self.rank.values(), default=0) + 1, -2, np.int32)
        for p, r in self.rank.items():
            self.of_rank[r] = self.ids[p] if self.of_rank[r] == -2 else -1
        self.byte_length = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.byte_start, self.byte_pool = np.cumsum(self.byte_length) - self.byte_length, np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _hash_table(self, pairs: np.ndarray) -> None:
        """Open addressing over (key, rank, joined piece): a slot for each pair, the next free one where it is taken; under a quarter is filled."""
        self.shift = np.uint64(64 - (4 * len(pairs)).bit_length())
        slots = (1 << 64 - int(self.shift)) + 64
        self.pair_keys, self.pair_ranks, self.pair_joined = np.full(slots, -1, np.int64), np.full(slots, NONE, np.int32), np.full(slots, -1, np.int32)
        at = self._slots(pairs[:, 0])
        while len(pairs):
            free = np.flatnonzero(self.pair_keys[at] == -1)
            taken, first = np.unique(at[free], return_index=True)
            now = free[first]
            self.pair_keys[taken], self.pair_ranks[taken], self.pair_joined[taken] = pairs[now].T
            left = np.ones(len(pairs), bool)
            left[now] = False
            pairs, at = pairs[left], at[left] + 1

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(_STRIDE) >> self.shift).astype(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs of pieces stand in the hash table; an empty slot for those that join with nothing."""
        key = left.astype(np.int64) << 20 | right
        at = self._slots(key)
        there = self.pair_keys[at]
        off = np.flatnonzero((there != key) & (there != -1))
        while len(off):
            at[off] += 1
            there = self.pair_keys[at[off]]
            off = off[(there != key[off]) & (there != -1)]
        return at

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of candidates, NONE where nothing joins; a piece below 0 joins with nothing."""
        return np.where((left >= 0) & (right >= 0), self.pair_ranks[self._found(left, right)], NONE)

    def skips(self, key: int, place: int, rank: int) -> bool:
        """Whether the occurrence `key` of a word skips the candidate of this rank whose left side starts at `place`."""
        return scattered((key + place * _PLACE + rank * _RANK) & _M) >> 11 < self.threshold

    def _skipped(self, keys: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """`skips` for arrays."""
        drawn = scattered(keys + place.astype(np.uint64) * np.uint64(_PLACE) + rank.astype(np.uint64) * np.uint64(_RANK))
        return drawn >> np.uint64(11) < np.uint64(self.threshold)

    def encode(self, text: str, key: int = 0, epoch: int = 0) -> list[int]:
        """Piece ids; (key, epoch), a document id's hash and the number of its repeat, pick the skips."""
        return self.encode_many([text], [text_key(self.seed, key, epoch)])[0].tolist()

    def encode_many(self, texts: list[str], starts: list[int]) -> list[np.ndarray]:
        """Piece ids of texts, `starts` being their text keys."""
        flat, counts = self.encode_flat(texts, starts)
        return np.split(flat, np.cumsum(counts)[:-1]) if texts else []

    def encode_flat(self, texts: list[str], starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in one array, and how many each has."""
        counts, found, held, size = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], [], 0

        def together() -> None:
            texts_of, words, keys, before = zip(*held)
            ids, n = self._together(words, np.array(keys, np.uint64), np.array(before, np.int64))
            np.add.at(counts, list(texts_of), n)
            found.append(ids)
            held.clear()

        for i, text in enumerate(texts):
            before = 0
            for part in self._portions(" " + text if text else ""):
                held.append((i, self.units.findall(part), starts[i], before))
                before += len(held[-1][1])
                size += len(part)
                if size >= TOGETHER:
                    together()
                    size = 0
        if held:
            together()
        return np.concatenate(found), counts

    def word_sizes(self, words: list[str]) -> np.ndarray:
        """How many pieces each word (a match of `units`) has; for an encoder without dropout, where that depends on the word alone."""
        none = np.zeros(len(words), np.int64)
        return self._together(tuple([w] for w in words), none.astype(np.uint64), none)[1]

    @staticmethod
    def _portions(text: str) -> Iterator[str]:
        """A text in portions of about TOGETHER characters, cut in front of white space, where no word is cut."""
        at = 0
        while at < len(text):
            end = at + TOGETHER
            if end < len(text):
                cut = text.rfind(" ", at + 1, end)
                while cut > at and text[cut - 1] == " ":
                    cut = text.rfind(" ", at + 1, cut)
                if cut <= at:
                    m = re.compile("(?<=[^ ]) ").search(text, end)
                    cut = m.start() if m else len(text)
                end = cut
            yield text[at:end]
            at = end

    def _together(self, words: tuple[list[str], ...], starts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of lists of words, and how many each list has; starts: their text keys, before: words of the text in front of them."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        total, kinds = int(counts.sum()), Numbers()
        kind = np.fromiter(map(kinds.__getitem__, chain.from_iterable(words)), np.int64, total)
        number = np.arange(1, total + 1) - np.repeat(np.cumsum(counts) - counts - before, counts)
        key = scattered(np.repeat(starts, counts) + number.astype(np.uint64) * np.uint64(_STRIDE))
        names = list(kinds)
        length = np.fromiter(map(len, names), np.int64, len(names))
        points = self.of_char[np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)]
        start = np.cumsum(length) - length
        known = np.logical_and.reduceat(points >= 0, start) if len(names) else np.zeros(0, bool)
        place, size, pool, used = np.zeros(total, np.int64), np.zeros(total, np.int64), [], 0

        def put(rows: np.ndarray, which: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            """Occurrences `rows` have the pieces number `which` of those in ids, n a piece list."""
            nonlocal used
            place[rows], size[rows] = (used + np.cumsum(n) - n)[which], n[which]
            pool.append(ids)
            used += len(ids)

        low = 0
        for width in WIDTHS:
            some = np.flatnonzero(known & (length > low) & (length <= width))
            low = width
            if not len(some):
                continue
            state = np.full(len(names), -1, np.int64)
            state[some] = np.arange(len(some))
            rows = np.flatnonzero(state[kind] >= 0)
            sym = np.full((len(some), width), -1, np.int32)
            inside = np.arange(width) < length[some][:, None]
            sym[inside] = points[(start[some][:, None] + np.arange(width))[inside]]
            self._agenda(sym, rows, state[kind[rows]], key[rows], put)
        # A single character outside the vocabulary has no candidates; other words without a table go one by one.
        alone = ~known & (length == 1)
        rows, merged = np.flatnonzero(alone[kind]), [self.merge(names[k], 0) for k in np.flatnonzero(alone)]
        put(rows, (np.cumsum(alone) - 1)[kind[rows]], *_joined(merged))
        rows = np.flatnonzero(~(alone | known & (length <= WIDTHS[-1]))[kind])
        put(rows, np.arange(len(rows)), *_joined([self.merge(names[kind[i]], int(key[i])) for i in rows]))
        ids = np.concatenate(pool) if pool else np.zeros(0, np.int32)
        offset = np.cumsum(size) - size
        out = ids[np.repeat(place - offset, size) + np.arange(int(size.sum()))]
        return out, np.add.reduceat(np.append(size, 0), np.minimum(np.cumsum(counts) - counts, total)) * (counts > 0)

    def _agenda(self, sym: np.ndarray, rows: np.ndarray, state: np.ndarray, key: np.ndarray, put) -> None:
        """Take candidates until none is left; state: the row of `sym` (pieces by place, -1 where none starts) of each of the occurrences."""
        width = sym.shape[1]
        right = np.where(np.append(sym[:, 1:] >= 0, np.zeros((len(sym), 1), bool), axis=1), np.arange(1, width + 1), -1).astype(np.int8)
        left = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int8), sym.shape).copy()
        rank = np.full(sym.shape, NONE, np.int32)
        rank[:, :-1] = self._ranked(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(sym), -1)
        while len(rows):
            place = rank.argmin(1)
            best = rank[np.arange(len(rank)), place]
            over = best == NONE
            if over.any():
                done, which = sym[over], np.cumsum(over) - 1
                there, ended = done >= 0, over[state]
                put(rows[ended], which[state[ended]], done[there], there.sum(1))
                rows, state, key = rows[~ended], state[~ended], key[~ended]
            reached = np.zeros(2 * len(sym), bool)
            code = 2 * state + self._skipped(key, place[state], best[state]) if self.threshold else 2 * state
            reached[code] = True
            state = (np.cumsum(reached) - 1)[code]
            come = np.flatnonzero(reached)
            parent, skip = come >> 1, (come & 1).astype(bool)
            sym, left, right, rank, place, best = (np.take(x, parent, axis=0) for x in (sym, left, right, rank, place, best))
            rank[np.flatnonzero(skip), place[skip]] = NONE
            s = np.flatnonzero(~skip)
            p = place[s]
            q = right[s, p].astype(np.int64)
            after = right[s, q].astype(np.int64)
            joined = self.of_rank[best[s]]
            if (joined < 0).any():
                joined = self.pair_joined[self._found(sym[s, p], sym[s, q])]
            sym[s, p], sym[s, q] = joined, -1
            rank[s, q], right[s, p] = NONE, after
            more = np.flatnonzero(after >= 0)
            left[s[more], after[more]] = p[more]
            rank[s, p] = NONE
            rank[s[more], p[more]] = self._ranked(sym[s[more], p[more]], sym[s[more], after[more]])
            prior = left[s, p].astype(np.int64)
            more = np.flatnonzero(prior >= 0)
            rank[s[more], prior[more]] = self._ranked(sym[s[more], prior[more]], sym[s[more], p[more]])

    def merge(self, unit: str, key: int) -> list[int]:
        """The agenda on one word of any length, with a heap and links."""
        symbols, n, rank = list(unit), len(unit), self.rank.get
        left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (r := rank(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (r, i, j, len(symbols[i]), len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            r, i, j, a, b = heapq.heappop(heap)
            if len(symbols[i]) != a or len(symbols[j]) != b or right[i] != j or self.skips(key, i, r):
                continue
            symbols[i], symbols[j], right[i] = symbols[i] + symbols[j], "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        ids = self.ids.get
        return list(chain.from_iterable([i] if (i := ids(s)) is not None else [self.of_byte[b] for b in s.encode("utf-8", "surrogatepass")] for s in symbols if s))

    def decode(self, ids) -> str:
        """The text of the pieces, without the space in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def decoded_bytes(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """UTF-8 of the texts of piece lists that stand in one array, without the spaces in front."""
        n = self.byte_length[ids]
        ends = np.cumsum(n)
        whole = memoryview(self.byte_pool[np.repeat(self.byte_start[ids] - ends + n, n) + np.arange(int(n.sum()))].tobytes())
        stops = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        return [whole[a + 1 : b] for a, b in zip(stops, stops[1:])]


@lru_cache(maxsize=4)
def shared(path: str, dropout: float, seed: int, merges: int | None = None) -> Pieces:
    """One encoder in each Python worker."""
    return Pieces(path, dropout, seed, merges)


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about TOGETHER characters, at least one row each."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= TOGETHER:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def encode_documents(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", epoch_col: str | None = None, out: str = "pieces", proof: str | None = None) -> DataFrame:
    """`docs` with the piece ids of every text; with `proof` also the SHA-256 of what they decode to, in a column of that name.

    `epoch_col` numbers the repeats of a document, which then have segmentations of their own. Record batches go through in slices of about
    TOGETHER characters, so a task holds few encoded texts at a time.
    """
    new = [out, proof] if proof else [out]
    epoch = F.coalesce(docs[epoch_col].cast("long"), F.lit(0)) if epoch_col else F.lit(0)
    keyed = docs.select(*[docs[c] for c in docs.columns if c not in new], F.xxhash64(docs[id_col]).alias("__piece_key"), epoch.cast("long").alias("__piece_epoch"))
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(proof, T.StringType())] if proof else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared(path, dropout, seed)
        for whole in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(whole.column(text_col)), 0).to_pylist()):
                part = whole.slice(a, b - a)
                texts = part.column(text_col).to_pylist()
                starts = [text_key(seed, k & _M, e) for k, e in zip(part.column("__piece_key").to_pylist(), part.column("__piece_epoch").to_pylist())]
                ids, counts = coder.encode_flat([t or "" for t in texts], starts)
                none = np.array([t is None for t in texts])
                columns = [part.column(f.name) for f in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(none)))
                if proof:
                    columns.append(pa.array([None if t is None else hashlib.sha256(d).hexdigest() for t, d in zip(texts, coder.decoded_bytes(ids, counts))], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return keyed.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str = MODEL, pieces_col: str = "pieces", out: str = "text") -> DataFrame:
    """`docs` with the text of the pieces."""

    def batch(pieces: pd.Series) -> pd.Series:
        coder = shared(path, 0.0, 0)
        return pd.Series([None if p is None else coder.decode(p.tolist() if hasattr(p, "tolist") else p) for p in pieces], dtype=object)

    return docs.withColumn(out, F.pandas_udf(batch, "string")(F.col(pieces_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text with dropout and decodes it again."""
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), proof="decoded_sha256")
    ids = F.sha2(F.array_join("pieces", " ").cast("binary"), 256)
    lossless = F.col("decoded_sha256").eqNullSafe(F.sha2(F.col("text").cast("binary"), 256))
    return coded.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.size("pieces").cast("long").alias("n_pieces"), ids.alias("pieces_sha256"), "decoded_sha256", lossless.alias("lossless"))
