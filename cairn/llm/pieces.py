"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid end to end and indexed by a suffix
array over as many characters as the longest piece has. Every piece is looked
up by binary search; the ranges found are all its occurrences, and each is an
edge from where it begins to where it ends. The edges are sorted by position
and relaxed from left to right.

A unigram model relaxes to the best sum of scores. For a merge (BPE) model the
segmentation of a prefix is unique, and it ends with the only piece that can
follow the segmentation before it without merging differently; an edge is
taken if its piece fits so behind the piece that ends where it begins. Whether
two pieces fit is decided on how they came about: they do not if, on the way,
a merge over their border would have come first.

Pieces never run over the border between two words, so words are encoded each
for itself, once per batch; runs of blanks, whose pieces share one score, are
merged one by one. Characters that the model lacks become byte pieces.

A null or empty text has no pieces. U+2581 stands for a blank in the model, so
a text that holds it decodes to one with blanks; every other text round-trips.
Rows are encoded each for itself, so rows and ids may repeat.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
KEPT_WORDS = 1 << 19  # words whose pieces a worker remembers
SLICE = 200_000  # characters that one suffix array indexes, or one word; an edge takes about 100 bytes, a character has several

# --- the model file -----------------------------------------------------------


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    merges: bool  # BPE rather than unigram
    dummy_prefix: bool = True
    words: dict[str, int] = field(init=False)  # words met before; looking a new one up numbers it
    kept_words: int = KEPT_WORDS
    slice_chars: int = SLICE

    def __post_init__(self):
        self.forget()
        usable = (NORMAL, USER)
        self.number = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in usable}
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.longest = max(map(len, self.number))
        self.piece_sizes = np.array([len(p) for p in self.pieces])
        letters = sorted({c for p in self.number for c in p})
        self.rank = {c: i + 1 for i, c in enumerate(letters)}
        inner = [p for p in self.number if BLANK in p.lstrip(BLANK) or (p[:2] == BLANK * 2 and p.strip(BLANK))]
        if inner:
            raise ValueError(f"pieces that run over words are not supported: {inner[:3]}")
        known = "".join(re.escape(c) for c in self.number if len(c) == 1 and c != BLANK)
        self.unit = re.compile(f"{BLANK}*[{known}]+|{BLANK}+|.", re.DOTALL)
        if self.merges:
            self.make_splits()
        self.make_keys()

    def forget(self) -> None:
        """Start anew with the pieces of words met before: word k has ``sizes[k]`` of the pieces in ``flat``."""
        self.words = defaultdict(count().__next__)
        self.flat, self.sizes = np.zeros(0, dtype="int32"), np.zeros(0, dtype="int64")

    # how pieces come about

    def make_splits(self) -> None:
        """Last merge of every piece, and the number of the piece that two pieces merge to."""
        pairs = [(self.number[p[:k]], self.number[p[k:]], i) for p, i in self.number.items() for k in range(1, len(p)) if p[:k] in self.number and p[k:] in self.number]
        table = np.array(pairs or [(0, 0, 0)], dtype="int64")
        size = len(self.pieces)
        order = np.argsort(table[:, 0] * size + table[:, 1])
        self.pair, self.merged = (table[:, 0] * size + table[:, 1])[order], table[order, 2]
        # the place of a piece among merges: higher scores merge first
        self.turn = np.empty(size, dtype="int64")
        self.turn[np.argsort(-self.scores, kind="stable")] = np.arange(size)
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.whole = np.zeros(size, dtype=bool)  # merges to itself
        for p, i in self.number.items():
            made = self.merge(p, limit=i)
            if len(p) == 1:
                self.whole[i] = True
            elif len(made) == 2:
                self.left[i], self.right[i] = made
                self.whole[i] = self.merge(p) == [i]

    def merge(self, text: str, limit: int = -1) -> list[int]:
        """Pieces of a text by merging the best pair until none is left, or before making ``limit`` of it all."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if 0 <= i and j < len(parts) and (n := self.number.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[n], i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, made = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != made:
                continue
            if limit >= 0 and len(made) == len(text):
                break
            parts[i], parts[j], after[i] = made, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.number[p] for p in parts if p is not None]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can follow piece a: no merge over their border comes before their own merges.

        Undo the later of the two last merges again and again; what lies at
        the border then is what lay there when that merge was made. A merge
        over the border that has its turn earlier, or the same turn and stands
        to the left, would have been made instead.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), dtype=bool)
        # the merge that was undone last: its turn, and whether it was of b
        limit, of_b = np.full(len(a), np.iinfo("int64").max), np.zeros(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * len(self.pieces) + y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            over = np.where(self.pair[at] == key, self.turn[self.merged[at]], np.iinfo("int64").max)
            bad = (over < limit[live]) | ((over == limit[live]) & of_b[live] & (over < np.iinfo("int64").max))
            good[live[bad]] = False
            x_turn = np.where(self.left[x] >= 0, self.turn[x], -1)
            y_turn = np.where(self.left[y] >= 0, self.turn[y], -1)
            undo_b = (y_turn >= x_turn) & (y_turn >= 0)
            undo_a = ~undo_b & (x_turn >= 0)
            limit[live] = np.where(undo_b, y_turn, x_turn)
            of_b[live] = undo_b
            a[live], b[live] = np.where(undo_a, self.right[x], x), np.where(undo_b, self.left[y], y)
            live = live[~bad & (undo_a | undo_b)]
        return good

    # suffix array

    def key(self, ranks: np.ndarray) -> np.ndarray:
        """Rows of character ranks as byte strings that sort alike."""
        return np.ascontiguousarray(ranks.astype(">u2")).view(f"S{2 * ranks.shape[1]}").ravel()

    def make_keys(self) -> None:
        """Least and greatest key of the suffixes that begin with each piece."""
        self.looked_up = np.array([i for p, i in self.number.items() if not (set(p) == {BLANK} and len(p) > 1) and (not self.merges or self.whole[i])])
        low = np.zeros((len(self.looked_up), self.longest), dtype="int64")
        high = np.full((len(self.looked_up), self.longest), 0xFFFF)
        for row, i in enumerate(self.looked_up):
            ranks = [self.rank[c] for c in self.pieces[i]]
            low[row, : len(ranks)] = high[row, : len(ranks)] = ranks
        # a key of ranks alone would lose zeros at its end, which sort first anyway
        self.low, self.high = self.key(low), self.key(high)
        self.length = np.array([len(self.pieces[i]) for i in self.looked_up])

    def edges(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of every occurrence of every piece in a line of ranks, by end and begin."""
        padded = np.concatenate([line, np.zeros(self.longest, dtype=line.dtype)])
        suffixes = self.key(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[: len(line)])
        array = np.argsort(suffixes, kind="stable")
        ordered = suffixes[array]
        first, last = np.searchsorted(ordered, self.low), np.searchsorted(ordered, self.high, side="right")
        count = last - first
        of = np.repeat(np.arange(len(count)), count)
        begin = array[np.repeat(first, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)]
        end = begin + self.length[of]
        order = np.lexsort((begin, end))
        return begin[order], end[order], self.looked_up[of[order]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words, one word after another, and how many each has; all characters are pieces."""
        part = np.cumsum([len(w) + 1 for w in words]) // self.slice_chars
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(words)]
        found = [self.encode_slice(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate([f for f, _ in found]), np.concatenate([n for _, n in found])

    def encode_slice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by one suffix array."""
        line = self.line_of(words)
        sizes = np.array([len(w) for w in words])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        begin, end, piece = self.edges(line)
        word = np.searchsorted(starts, begin, side="right") - 1
        depth = end - starts[word]  # edges are relaxed by where they end in their word
        order = np.argsort(depth, kind="stable")
        begin, end, piece, depth, word = (x[order] for x in (begin, end, piece, depth, word))
        steps = np.searchsorted(depth, np.arange(1, sizes.max() + 2))
        last = np.full(len(line) + 1, -1)  # the piece that ends at a position
        best = np.full(len(line) + 1, -np.inf)
        best[starts] = 0.0
        for lo, hi in zip(steps[:-1], steps[1:], strict=True):
            i, j, p = begin[lo:hi], end[lo:hi], piece[lo:hi]
            if self.merges:
                opening = i == starts[word[lo:hi]]
                reached = opening | (last[i] >= 0)
                i, j, p, opening = i[reached], j[reached], p[reached], opening[reached]
                good = opening.copy()
                good[~opening] = self.fits(last[i[~opening]], p[~opening])
                last[j[good]] = p[good]
            else:
                value = best[i] + self.scores[p]
                order = np.lexsort((value, j))
                j, p, value = j[order], p[order], value[order]
                top = np.concatenate([j[1:] != j[:-1], [True]]) if len(j) else np.zeros(0, dtype=bool)
                top &= value > -np.inf
                best[j[top]], last[j[top]] = value[top], p[top]
        return self.read_back(last, starts, sizes)

    def line_of(self, words: list[str]) -> np.ndarray:
        """Character ranks of the words, each followed by 0."""
        points = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), dtype="<u4")
        used, at = np.unique(points, return_inverse=True)
        return np.array([self.rank.get(chr(c), 0) if c else 0 for c in used])[at]

    def read_back(self, last: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the pieces from the ends of all words to their beginnings, side by side."""
        size = self.piece_sizes
        at, word, found, owner = starts + sizes, np.arange(len(starts)), [], []
        while len(at):
            piece = last[at]
            if (piece < 0).any():
                raise ValueError("a word has no segmentation")
            found.append(piece)
            owner.append(word)
            at = at - size[piece]
            going = at > starts[word]
            at, word = at[going], word[going]
        piece, of = np.concatenate(found[::-1]), np.concatenate(owner[::-1])
        return piece[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(starts))

    # texts

    def learn(self, units: list[str]) -> None:
        """Add distinct new units: words, words after several blanks, blanks, or unknown characters."""
        odd, plain = {}, []
        for k, unit in enumerate(units):
            if len(unit) == 1 and unit not in self.number:
                odd[k] = [self.byte[b] for b in unit.encode()] if self.byte else [self.unknown]
            elif unit[:2] == BLANK * 2:
                odd[k] = self.merge(unit) if self.merges else self.best_path(unit)
            else:
                plain.append(k)
        sizes = np.zeros(len(units), dtype="int64")
        flat = np.zeros(0, dtype="int64")
        if plain:
            flat, sizes[plain] = self.encode_words([units[k] for k in plain])
        if odd:
            sizes[list(odd)] = [len(ids) for ids in odd.values()]
            whole = np.empty(sizes.sum(), dtype="int64")
            is_odd = np.zeros(len(units), dtype=bool)
            is_odd[list(odd)] = True
            from_odd = np.repeat(is_odd, sizes)
            whole[~from_odd], whole[from_odd] = flat, [i for ids in odd.values() for i in ids]
            flat = whole
        self.flat = np.concatenate([self.flat, flat.astype("int32")])
        self.sizes = np.concatenate([self.sizes, sizes])

    def best_path(self, text: str) -> list[int]:
        """Best sum of scores over a single unit."""
        best: list[tuple[float, list[int] | None]] = [(0.0, [])] + [(-np.inf, None)] * len(text)
        back: list[tuple[int, int]] = [(0, -1)] * (len(text) + 1)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - self.longest), j):
                n = self.number.get(text[i:j])
                if n is not None and best[i][0] + self.scores[n] > best[j][0]:
                    best[j], back[j] = (best[i][0] + self.scores[n], None), (i, n)
        found, j = [], len(text)
        while j:
            j, n = back[j]
            found.append(n)
        return found[::-1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text)."""
        if len(self.words) > self.kept_words:
            self.forget()
        words, before = self.words, len(self.words)
        uses, counts = [], []
        for text in texts:
            line = ((BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)) if text else ""
            found = self.unit.findall(line)
            uses.extend(map(words.__getitem__, found))
            counts.append(len(found))
        if len(words) > before:
            self.learn(list(islice(words, before, None)))
        used = np.array(uses, dtype="int64")
        ends = np.concatenate([[0], np.cumsum(self.sizes[used])])
        borders = ends[np.concatenate([[0], np.cumsum(counts)]).astype("int64")]
        return gathered(self.flat, self.sizes, used), np.diff(borders)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts; bytes that are no UTF-8 become U+FFFD, unknown and control pieces vanish."""
        if not hasattr(self, "raw"):
            parts = []
            for piece, kind in zip(self.pieces, self.kinds, strict=True):
                parts.append(bytes([int(piece[1:-1], 16)]) if kind == BYTE else piece.replace(BLANK, " ").encode() if kind in (NORMAL, USER) else b"")
            self.raw = np.frombuffer(b"".join(parts), dtype="u1")
            self.raw_sizes = np.array([len(p) for p in parts], dtype="int64")
        data = gathered(self.raw, self.raw_sizes, ids).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.raw_sizes[ids])])[np.concatenate([[0], np.cumsum(counts)]).astype("int64")]
        texts = []
        for a, b, first in zip(ends[:-1].tolist(), ends[1:].tolist(), self.opens_with_blank(ids, counts), strict=True):
            texts.append(data[a + first : b].decode("utf-8", "replace"))
        return texts

    def opens_with_blank(self, ids: np.ndarray, counts: np.ndarray) -> list[int]:
        """1 for texts whose first piece brings the blank that encoding put ahead."""
        if not hasattr(self, "blank_first"):
            self.blank_first = np.array([p[:1] == BLANK and k in (NORMAL, USER) for p, k in zip(self.pieces, self.kinds, strict=True)])
        starts = np.cumsum(counts) - counts
        return [int(self.dummy_prefix and n > 0 and self.blank_first[ids[s]]) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]


def gathered(flat: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The stretches ``used`` of ``flat``, which is cut into ``sizes``, one after another."""
    starts, lengths = (np.cumsum(sizes) - sizes)[used], sizes[used]
    total = np.cumsum(lengths)
    return flat[np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]


def read_model(data: bytes) -> Model:
    pieces, scores, kinds, merges, dummy = [], [], [], False, True
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
            pieces.append(piece[1].decode())
            scores.append(np.frombuffer(piece[2], "<f4")[0])
            kinds.append(piece[3])
        elif number == 2:
            kind = dict(fields(value)).get(3, UNIGRAM)
            if kind not in (UNIGRAM, BPE):
                raise ValueError("only unigram and BPE models are supported")
            merges = kind == BPE
        elif number == 3:
            spec = {1: b"", 3: 1, 4: 1} | dict(fields(value))
            if spec[1] != b"identity" or spec[4]:
                raise ValueError("only models without normalisation are supported")
            dummy = bool(spec[3])
    return Model(pieces, np.array(scores, dtype="float64"), np.array(kinds), merges, dummy)


@lru_cache(maxsize=2)
def shipped_model(name: str) -> Model:
    """The model file that Spark has sent to this executor, read once per worker."""
    with open(SparkFiles.get(name), "rb") as file:
        return read_model(file.read())


# --- tables -------------------------------------------------------------------


def ship(docs: DataFrame, path: str) -> str:
    """Send the model file to the executors; its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encoded(
    docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", kept_words: int = KEPT_WORDS, slice_chars: int = SLICE
) -> DataFrame:
    """doc_id, ids, n_tokens and ``exact``: whether decoding the ids gives the text back.

    ``kept_words`` and ``slice_chars`` trade a worker's memory for time; the pieces are the same.
    """
    name = ship(docs, path)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped_model(name)
        model.kept_words, model.slice_chars = kept_words, slice_chars
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts = model.encode(texts)
            exact = [a == b for a, b in zip(texts, model.decode(ids, counts), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), "int32"), pa.array(ids, "int32"))
            columns = [batch.column(0), lists, pa.array(counts, "int64"), pa.array(exact)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "exact"])

    picked = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(made, "doc_id bigint, ids array<int>, n_tokens bigint, exact boolean")


def decoded(rows: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of rows with piece ids; null ids give an empty text."""
    name = ship(rows, path)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped_model(name)
        for batch in batches:
            lists = batch.column(1)
            counts = np.asarray(lists.value_lengths().fill_null(0), dtype="int64")
            texts = model.decode(np.asarray(lists.flatten(), dtype="int64"), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, "string")], ["doc_id", "text"])

    return rows.select(F.col(id).cast("bigint").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(made, "doc_id bigint, text string")
