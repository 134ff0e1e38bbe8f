"""Substring dedup with repeated-phrase automata.

A window is ``SIZE`` consecutive words of a text. Every word under a window
that also starts in a document of a smaller id is removed.

1. Rows are dealt into blocks by id and text, so that neither null ids nor a
   repeated one fill a block. A block sends the anchors of its
   windows: the smallest hash among a window's ``ANCHOR``-word shingles
   (winnowing). Equal windows have equal anchors, so a window whose anchor
   stands in one document only cannot recur; a quarter of the words send one.
2. Blocks that hold a shared anchor hear of it and send the passages around it,
   each distinct one once with its smallest and largest id. A very common
   anchor is taken apart into its windows, so no key brings a task more than a
   row a block.
3. Passages meet sorted by anchor. Their windows are compared byte by byte,
   which confirms those that recur and gives each its owner, the smallest id.
   (A document without a shared anchor can hold none and sends nothing.)
4. A block hears of its passages whose windows have an earlier owner, by their
   words, with the owners as runs. They are dealt into shards of at most about
   ``SHARD_WORDS`` words, each compiled into an Aho-Corasick automaton, and all
   documents of the block are streamed through each; the occurrences that the
   automata report say which words are removed. (Words are told apart by 64-bit
   hashes there.)

The texts move once: the plan reuses the exchange by block. Ids are integers; a
null id counts as the largest. Null or empty text: no words. Rows of one id are
one document for the comparison, and each row is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import Words, ragged, text_chunks, text_or_empty

SIZE, ANCHOR = 13, 7
BLOCK_BYTES, SHARD_ROWS, COMMON = 4 << 20, 20_000, 2_000
SHARD_WORDS = 150_000
LETTERS = 64
_NULL = np.iinfo(np.int64).max


class Windows:
    """Windows of the words of a chunk: ``hash`` and ``anchor`` by first word, where ``valid``; ``word`` has the words' hashes."""

    def __init__(self, words: Words):
        self.word = hashes = words.hashes()
        n = len(hashes)
        self.valid, self.hash = np.zeros(n, bool), np.zeros(n, np.uint64)
        value, at = words.shingles(hashes, SIZE)
        self.valid[at], self.hash[at] = True, value
        short = np.zeros(n, np.uint64)
        value, at = words.shingles(hashes, ANCHOR)
        short[at] = value
        self.at = np.flatnonzero(self.valid)
        steps = SIZE - ANCHOR + 1
        low = short[self.at]
        for j in range(1, steps):
            np.minimum(low, short[self.at + j], out=low)
        place = self.at.copy()
        for j in range(1, steps):
            place = np.where(short[self.at + j] == low, self.at + j, place)
        self.anchor, self.place = low, place


def _chunks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(bytes, offsets, ids as numbers, ids) of the texts of a block."""
    table = table.combine_chunks()
    if not table.num_rows:
        return
    text, ids = table.column("text").chunk(0), table.column("id").chunk(0)
    numbers = ids.fill_null(_NULL).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, end, data, offsets in text_chunks(text):
        yield data, offsets, numbers[first:end], ids.slice(first, end - first)


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(the words, each followed by one blank, offset of each)."""
    lengths = words.ends - words.starts + 1
    edges = np.concatenate([[0], np.cumsum(lengths)])
    at = ragged(words.starts, lengths)
    at[edges[1:] - 1] = 0
    out = words.data[at] if len(at) else np.zeros(0, np.uint8)
    out[edges[1:] - 1] = 32
    return out, edges


def _anchors(key: tuple, table: pa.Table) -> pa.Table:
    seen, owner = [], []
    for data, offsets, ids, _ in _chunks(table):
        words = Words(data, offsets)
        w = Windows(words)
        if not len(w.at):
            continue
        new = np.concatenate([[True], w.place[1:] != w.place[:-1]])  # windows in a row mostly share their anchor
        seen.append(w.anchor[new])
        owner.append(ids[words.doc[w.at[new]]])
    if not seen:
        return pa.table({"h": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "docs": pa.array([], pa.int32())})
    h, ids = np.concatenate(seen), np.concatenate(owner)
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    fresh = first | np.concatenate([[True], ids[1:] != ids[:-1]])
    begin = np.flatnonzero(first)
    docs = np.add.reduceat(fresh.astype(np.int64), begin)
    h = h[begin]
    return pa.table({"h": pa.array(h.view(np.int64)), "block": pa.array(np.full(len(h), key[0].as_py(), np.int32)), "docs": pa.array(docs.astype(np.int32))})


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut so that equal values stay together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.searchsorted(table.column(0).to_numpy(), table.column(0)[-1].as_py()))
        if cut:
            yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches, 100_000):
        h, block, docs = (table.column(i).to_numpy() for i in range(3))
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.repeat(np.add.reduceat(docs.astype(np.int64), begin), np.diff(np.append(begin, len(h))))
        hit = total > 1
        yield pa.RecordBatch.from_arrays([pa.array(block[hit]), pa.array(h[hit]), pa.array(total[hit] > COMMON)], names=["block", "h", "common"])


def _passages(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
    order = np.argsort(told.column("h").to_numpy().view(np.uint64), kind="stable")
    shared = told.column("h").to_numpy().view(np.uint64)[order]
    common = told.column("common").combine_chunks().to_numpy(zero_copy_only=False)[order] if told.num_rows else np.zeros(0, bool)
    found: dict[tuple, list] = {}
    for data, offsets, ids, _ in _chunks(table):
        if not len(shared):
            break
        words = Words(data, offsets)
        w = Windows(words)
        near = np.minimum(np.searchsorted(shared, w.anchor), len(shared) - 1)
        hit = np.flatnonzero(shared[near] == w.anchor)
        if not len(hit):
            continue
        at, place, apart = w.at[hit], w.place[hit], common[near[hit]]
        new = np.ones(len(hit), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]) | apart[1:]
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(hit)))
        first, last = at[begin], at[begin] + n - 1
        h = np.where(apart[begin], w.hash[first], w.anchor[hit][begin])
        spaced, edges = _spaced(words)
        raw = spaced.tobytes()
        owner = ids[words.doc[first]]
        for k, a, b, m, i, lo, hi in zip(h.tolist(), w.hash[first].tolist(), w.hash[last].tolist(), n.tolist(), owner.tolist(), edges[first].tolist(), edges[last + SIZE].tolist(), strict=True):
            if (old := found.get((k, a, b, m))) is None:
                found[k, a, b, m] = [i, i, raw[lo : hi - 1]]
            elif i < old[0]:
                old[0] = i
            elif i > old[1]:
                old[1] = i
    rows = list(found.values())
    return pa.table({"k": pa.array(np.array([x[0] for x in found], dtype=np.uint64).view(np.int64)), "block": pa.array(np.full(len(rows), key[0].as_py(), np.int32)), "lo": pa.array([r[0] for r in rows], pa.int64()), "hi": pa.array([r[1] for r in rows], pa.int64()), "words": pa.array([r[2] for r in rows], pa.binary())})


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches, SHARD_ROWS):
        column = table.column("words").combine_chunks()
        lo, hi, block = (table.column(c).to_numpy() for c in ("lo", "hi", "block"))
        number: dict[bytes, int] = {}
        same, row = [], []
        for first, _, data, offsets in text_chunks(column):
            words = Words(data, offsets)
            at = np.flatnonzero(words.doc[: len(words.doc) - SIZE + 1] == words.doc[SIZE - 1 :])
            raw = data.tobytes()
            same += [number.setdefault(raw[x:y], len(number)) for x, y in zip(words.starts[at].tolist(), words.ends[at + SIZE - 1].tolist(), strict=True)]
            row.append(words.doc[at] + first)
        of, row = np.array(same, np.int64), np.concatenate(row)
        owner = np.full(len(number), _NULL)
        np.minimum.at(owner, of, lo[row])
        losing = np.zeros(len(lo), bool)
        losing[row[owner[of] < hi[row]]] = True
        rows = np.flatnonzero(losing)
        if not len(rows):
            continue
        kept = losing[row]
        window_row, window_owner = row[kept], owner[of[kept]]
        fresh = np.ones(len(window_row), bool)
        fresh[1:] = (window_row[1:] != window_row[:-1]) | (window_owner[1:] != window_owner[:-1])
        begin = np.flatnonzero(fresh)
        edges = pa.array(np.searchsorted(window_row[begin], np.append(rows, len(lo))).astype(np.int32))
        runs = np.diff(np.append(begin, len(window_row))).astype(np.int32)
        found = pa.RecordBatch.from_arrays([column.take(pa.array(rows)), pa.ListArray.from_arrays(edges, pa.array(window_owner[begin])), pa.ListArray.from_arrays(edges, pa.array(runs))], names=["words", "owners", "runs"])
        order = np.argsort(block[rows], kind="stable")
        own, starts = np.unique(block[rows][order], return_index=True)
        parts = [_packed(found.take(pa.array(order[a:b]))) for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(order)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(parts, pa.binary())], names=["block", "pack"])


def _packed(batch: pa.RecordBatch) -> bytes:
    """Passages for one block, compressed together."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 6)


def _spelled(codes: np.ndarray, kinds: int) -> tuple[str, int]:
    """(codes below ``kinds`` spelled in letters, letters of each).

    A letter's value tells its place in a word, so that a match begins and ends
    with whole words, and nodes of the automaton, which searches the edges of a
    node one by one, have at most ``LETTERS`` edges.
    """
    width = 1
    while LETTERS**width < kinds:
        width += 1
    letters = np.empty((len(codes), width), np.uint32)
    for j in range(width):
        letters[:, j] = codes // LETTERS ** (width - 1 - j) % LETTERS + LETTERS * j + 1
    return letters.tobytes().decode("utf-32-le"), width


class Shard:
    """An automaton of some passages: ``hash`` has the hashes of their words, ``size`` how many words each has."""

    def __init__(self, hashes: np.ndarray, size: np.ndarray):
        self.known = np.unique(hashes)
        stream, self.width = _spelled(np.searchsorted(self.known, hashes) + 1, len(self.known) + 1)
        ends = np.cumsum(size) * self.width
        number: dict[str, int] = {}
        self.same = np.array([number.setdefault(stream[a:b], len(number)) for a, b in zip((ends - size * self.width).tolist(), ends.tolist(), strict=True)], np.int64)
        self.size = np.zeros(len(number), np.int64)
        self.size[self.same] = size
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase, k in number.items():
            self.automaton.add_word(phrase, k)
        self.automaton.make_automaton()
        self.order = np.argsort(self.same, kind="stable")  # passages told of more than once, by number
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(self.same, minlength=len(number)))])

    def occurrences(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, first word) of every occurrence in all documents of a chunk. Words that no passage has are all code 0, which also parts the documents."""
        near = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        part = np.arange(len(hashes)) + words.doc
        apart = np.zeros(len(hashes) + len(words.first) - 1, np.int64)
        apart[part] = np.where(self.known[near] == hashes, near + 1, 0)
        stream, width = _spelled(apart, len(self.known) + 1)
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(stream)), np.int64).reshape(-1, 2)
        first = (hits[:, 0] + 1) // width - self.size[hits[:, 1]]
        place = np.zeros(len(apart), np.int64)
        place[part] = np.arange(len(hashes))
        times = np.diff(self.edges)[hits[:, 1]]
        return self.order[ragged(self.edges[hits[:, 1]], times)], np.repeat(place[first], times)


def _shards(told: pa.Table) -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
    """(automaton, owners of the windows of its passages one after the other, first of them for each passage)."""
    if not told.num_rows:
        return
    told = pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(x.as_py())).read_all() for x in told.column("pack")]).combine_chunks()
    column, owners, runs = (told.column(c).chunk(0) for c in ("words", "owners", "runs"))
    whole = np.repeat(owners.flatten().to_numpy(zero_copy_only=False).astype(np.int64), runs.flatten().to_numpy(zero_copy_only=False))
    hashes, size = [], []
    for _, _, data, offsets in text_chunks(column):
        words = Words(data, offsets)
        hashes.append(words.hashes())
        size.append(np.diff(words.first))
    hashes, size = np.concatenate(hashes), np.concatenate(size).astype(np.int64)
    word, window = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(size - SIZE + 1)])
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(word, word[at] + SHARD_WORDS, side="right")) - 1)
        yield Shard(hashes[word[at] : word[end]], size[at:end]), whole[window[at] : window[end]], window[at : end + 1] - window[at]
        at = end


def _removal(text_out: bool):
    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        chunks = [(Words(data, offsets), ids, raw_ids) for data, offsets, ids, raw_ids in _chunks(table)]
        hashes = [words.hashes() for words, *_ in chunks]
        cover = [np.zeros(len(h) + 1, np.int32) for h in hashes]
        for shard, owners, edges in _shards(told):
            for (words, ids, _), own, marks in zip(chunks, hashes, cover, strict=True):
                if not len(own):
                    continue
                row, at = shard.occurrences(words, own)
                size = edges[row + 1] - edges[row]
                place = ragged(at, size)
                early = owners[ragged(edges[row], size)] < np.repeat(ids[words.doc[at]] if len(at) else np.zeros(0, np.int64), size)
                np.add.at(marks, place[early], 1)
                np.add.at(marks, place[early] + SIZE, -1)
        out_ids, n_words, n_removed, digests, texts = [], [], [], [], []
        for (words, _, raw_ids), marks in zip(chunks, cover, strict=True):
            gone = np.cumsum(marks[:-1]) > 0
            spaced, places = _spaced(words)
            kept = spaced[np.repeat(~gone, np.diff(places))]
            reach = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(places)))])[words.first]
            raw = kept.tobytes()
            parts = [raw[x : max(x, y - 1)] for x, y in zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True)]
            taken = np.concatenate([[0], np.cumsum(gone)])
            out_ids.append(raw_ids)
            n_words.append(np.diff(words.first))
            n_removed.append(np.diff(taken[words.first]))
            digests += [hashlib.sha256(p).hexdigest() for p in parts]
            if text_out:
                texts += parts
        columns = {"id": pa.chunked_array(out_ids, table.schema.field("id").type), "n_words": pa.array(np.concatenate([*n_words, np.zeros(0, np.int64)]).astype(np.int64)), "n_removed": pa.array(np.concatenate([*n_removed, np.zeros(0, np.int64)]).astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())}
        if text_out:
            columns["text"] = pa.array([t.decode() for t in texts], pa.string())
        return pa.table(columns)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: bool = True) -> DataFrame:
    """Columns: id, n_words, n_removed, kept_sha256 and, with ``text``, the kept words joined by blanks."""
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    by_block = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"), "id", "text")
    anchors = by_block.groupBy("block").applyInArrow(_anchors, "h bigint, block int, docs int")
    told = anchors.repartition("h").sortWithinPartitions("h").mapInArrow(_shared, "block int, h bigint, common boolean")
    passages = by_block.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_passages, "k bigint, block int, lo bigint, hi bigint, words binary")
    located = passages.repartition("k").sortWithinPartitions("k").mapInArrow(_located, "block int, pack binary")
    schema = f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * text
    out = by_block.groupBy("block").cogroup(located.groupBy("block")).applyInArrow(_removal(text), schema)
    return out.withColumnRenamed("id", id_col)
