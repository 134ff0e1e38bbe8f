"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex. Each code point becomes a symbol (letter,
number, space, other white space, apostrophe, other; letters that begin a
contraction's end have symbols of their own). A symbol is a transition
function of a nine-state automaton; functions compose associatively, so a
blocked scan over numbers of functions gives the state before every code
point, and the state with the symbol says whether a piece starts there.

Pieces are slices of the UTF-8 buffer. Arrow's dictionary encoding leaves the
distinct ones, which are merged pair by pair by rank and cached; ids are then
gathered per text. Byte offsets of the ids come from the lengths of the
vocabulary's entries, and decoding is a gather over one buffer of all entries.

A null text counts as empty: no ids. Texts are encoded whole. Rows with equal
ids or texts are treated alike and all returned.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindrift.llm.shared import ragged, text_chunks

# symbols
LETTER, LAST, FIRST, NUMBER, OTHER, QUOTE, BLANK, WHITE = range(8)
# states: what the code point before belongs to
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_WHITE, AFTER_QUOTE, CONTRACTED, CONTRACTING = range(9)
#: White space of the pattern's \s outside ASCII and inside it.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces of which the ids are kept by each worker; the store is emptied when full.
CACHE = 400_000
#: Bytes of text that are encoded at once: a worker keeps the room that the arrays of a chunk took.
ENCODED_BYTES = 1 << 19
#: No token: above every rank.
NONE = np.int32(1 << 30)


@lru_cache(1)
def _symbols() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[WHITE_SPACE] = WHITE
    table[32], table[39] = BLANK, QUOTE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at the symbol."""
    white = state in (AFTER_BLANK, AFTER_WHITE)
    if symbol in (BLANK, WHITE):
        return (AFTER_BLANK if symbol == BLANK else AFTER_WHITE), not white
    if symbol in (LETTER, LAST, FIRST):
        if state == CONTRACTING:
            return CONTRACTED, False
        if state == AFTER_QUOTE and symbol != LETTER:
            return (CONTRACTED if symbol == LAST else CONTRACTING), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if state in (IN_OTHERS, AFTER_QUOTE):
        return IN_OTHERS, False
    if state == AFTER_BLANK:
        return IN_OTHERS, False
    return (AFTER_QUOTE if symbol == QUOTE else IN_OTHERS), True


class _Monoid:
    """All compositions of the symbols' transition functions, numbered."""

    def __init__(self) -> None:
        states = range(9)
        one = [tuple(_step(s, c)[0] for s in states) for c in range(8)]
        fresh = [tuple([_step(START, c)[0]] * 9) for c in range(8)]
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(states), *one, *fresh]))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in list(known):
                for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                    if h not in known:
                        known[h] = len(known)
                        todo.append(h)
        self.apply = np.array(list(known), dtype=np.uint8)
        self.then = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], dtype=np.uint16)
        self.of_symbol = np.array([known[f] for f in one], dtype=np.uint16)
        self.of_first = np.array([known[f] for f in fresh], dtype=np.uint16)
        self.starts = np.array([[_step(s, c)[1] for c in range(8)] for s in states])

    def states(self, functions: np.ndarray, entry: int = START) -> np.ndarray:
        """State after each function, by a blocked scan."""
        n = len(functions)
        if n <= 64:
            out = np.empty(n, dtype=np.uint8)
            for i, f in enumerate(functions):
                out[i] = entry = self.apply[f, entry]
            return out
        width = 128
        rows = -(-n // width)
        padded = np.zeros(rows * width, dtype=np.uint16)  # function 0 is the identity
        padded[:n] = functions
        columns = np.ascontiguousarray(padded.reshape(rows, width).T)
        for j in range(1, width):
            columns[j] = self.then[columns[j - 1], columns[j]]
        entries = np.empty(rows, dtype=np.uint8)
        entries[0] = entry
        entries[1:] = self.states(columns[-1], entry)[:-1]
        return self.apply[columns, entries[None, :]].T.ravel()[:n]


@lru_cache(1)
def _monoid() -> _Monoid:
    return _Monoid()


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    if len(at) == len(data):
        return lead, at
    tail = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
    out = lead.copy()
    two, three, four = (np.flatnonzero((lead >= lo) & (lead < hi)) for lo, hi in ((0xC0, 0xE0), (0xE0, 0xF0), (0xF0, 0x100)))
    p = at[two]
    out[two] = (lead[two] & 0x1F) << 6 | tail[p + 1]
    p = at[three]
    out[three] = (lead[three] & 0x0F) << 12 | tail[p + 1] << 6 | tail[p + 2]
    p = at[four]
    out[four] = (lead[four] & 0x07) << 18 | tail[p + 1] << 12 | tail[p + 2] << 6 | tail[p + 3]
    return out, at


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pieces of the texts start (texts lie end to end in ``data``)."""
    points, at = code_points(data)
    n = len(points)
    if not n:
        return at
    symbol = _symbols()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[np.searchsorted(at, offsets[:-1])] = True
    first[n] = True
    last = first[1:]  # the last code point of its text
    follows = np.zeros(n, dtype=np.int32)
    follows[:-1] = np.where(last[:-1], 0, points[1:])
    single = (points == ord("s")) | (points == ord("t")) | (points == ord("m")) | (points == ord("d"))
    double = ((points == ord("r")) | (points == ord("v"))) & (follows == ord("e")) | (points == ord("l")) & (follows == ord("l"))
    symbol[single], symbol[double] = LAST, FIRST
    m = _monoid()
    after = m.states(np.where(first[:-1], m.of_first[symbol], m.of_symbol[symbol]))
    before = np.empty(n, dtype=np.uint8)
    before[0] = START
    before[1:] = after[:-1]
    before[first[:-1]] = START
    start = m.starts[before, symbol]
    white = symbol >= BLANK
    # the last white space before something else stands apart from the run it ends
    start[:-1] |= white[:-1] & ~white[1:] & ~last[:-1]
    return at[start]


class Coder:
    """Encodes and decodes by a file of ranks (base64 token and rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        entries = [b""] * size
        for token, rank in self.ranks.items():
            entries[rank] = token
        self.lengths = np.array([len(x) for x in entries], dtype=np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_to = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int32)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, or NONE."""
        key = left.astype(np.int64) << 32 | right
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_to[i], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as packed 32-bit numbers: merge the neighbours of the lowest rank, leftmost first, until no pair has one.

        All pieces take one merge a round, as segments of one array.
        """
        out = [b""] * len(pieces)
        ranks, short = self.ranks, []
        for i, piece in enumerate(pieces):
            if (whole := ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > 64:
                out[i] = np.array(self._merge_long(piece), dtype="<u4").tobytes()
            else:
                short.append(i)
        if not short:
            return out
        own = np.array(short)
        flat = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in short]), dtype=np.uint8)]
        sizes = np.fromiter((len(pieces[i]) for i in short), dtype=np.int64, count=len(short))
        rank = np.append(self._pair_ranks(flat[:-1], flat[1:]), NONE)
        rank[np.cumsum(sizes) - 1] = NONE
        while len(own):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            if (done := low == NONE).any():
                packed = flat.astype("<u4").tobytes()
                for i, a, b in zip(own[done].tolist(), (4 * starts[done]).tolist(), (4 * (starts + sizes)[done]).tolist(), strict=True):
                    out[i] = packed[a:b]
                stay = np.repeat(~done, sizes)
                own, sizes, flat, rank, low = own[~done], sizes[~done], flat[stay], rank[stay], low[~done]
                if not len(own):
                    break
                starts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            segment = np.searchsorted(starts, at, side="right") - 1
            at = at[np.concatenate([[True], segment[1:] != segment[:-1]])]
            flat[at] = low
            keep = np.ones(len(flat), dtype=bool)
            keep[at + 1] = False
            flat, rank = flat[keep], rank[keep]
            at -= np.arange(len(at))
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            ends = starts + sizes - 1
            rank[at] = NONE
            i = np.flatnonzero(at < ends)
            rank[at[i]] = self._pair_ranks(flat[at[i]], flat[at[i] + 1])
            i = np.flatnonzero(at > starts)
            rank[at[i] - 1] = self._pair_ranks(flat[at[i] - 1], flat[at[i]])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list: n log n for pieces without breaks."""
        ranks, n = self.ranks, len(piece)
        end, after, prior = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] - i != size:
                continue
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                prior[after[i]] = i
            for a, b in ((prior[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(piece[a : end[b]])) is not None:
                    heapq.heappush(heap, (r, a, end[b] - a))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text's ids)."""
        starts = piece_starts(data, offsets)
        n = len(starts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        distinct = coded.dictionary.to_pylist()
        new = [x for x in distinct if x not in cache]
        made = dict(zip(new, self.merge(new), strict=True))
        own = [made[x] if x in made else cache[x] for x in distinct]
        cache.update((x, ids) for x, ids in made.items() if len(x) <= 64)
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        flat = np.frombuffer(b"".join(own), dtype="<u4")
        index = coded.indices.to_numpy()
        lengths = sizes[index]
        ids = flat[ragged((np.cumsum(sizes) - sizes)[index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, byte offset of each id)."""
        lengths = self.lengths[ids]
        return self.pool[ragged(self.at[ids], lengths)], np.cumsum(lengths) - lengths


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per text: id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the ids and their byte offsets.

    ``path``: the file of ranks, present on every node as part of the installed package.
    """
    kind = dict(docs.dtypes)[id_col]
    extra = ", ids array<int>, byte_starts array<int>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), ENCODED_BYTES):
                flat, at = own.encode(data, offsets)
                back, starts = own.decode(flat)
                raw, n = flat.astype("<u4"), end - first
                reach = np.append(starts, len(back))[at]
                columns = [
                    batch.column(0).slice(first, n),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[at[i] : at[i + 1]]).hexdigest() for i in range(n)]),
                    pa.array([hashlib.sha256(back[reach[i] : reach[i + 1]]).hexdigest() for i in range(n)]),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    edges = pa.array(at.astype(np.int32))
                    local = starts - np.repeat(reach[:-1], np.diff(at))
                    columns += [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (flat, local)]
                    names += ["ids", "byte_starts"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
