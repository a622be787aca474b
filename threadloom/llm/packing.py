"""Documents packed into fixed-length token sequences.

Lengths are at most the capacity, so how often each occurs is a small table whatever the
corpus. The plan is made on that table: dominance reduction first fixes, for the largest
lengths, the sets that are at least as good as every alternative; best fit by decreasing
length packs the remainder, with equal bins as one pattern and a multiplicity. Documents
then find their place by their rank among those of equal length, in parallel.

Defined results: a null or empty text is a document of one end token; a document over the
capacity is cut into full pieces and a last one; repeated rows are packed once each;
columns beside id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bpe import Chunks, Specials, parts_of
from threadloom.llm.common import cut, sliced, spread_rank

Pattern = tuple[int, list[tuple[int, int]]]  # how many bins; (length, how many of it) in one bin


class LibraryChunks(Chunks):
    """Ids of chunks by the tokenizers library, which encodes those not seen yet in batches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.normalizer = None  # pieces come composed and in lower case; marks would be reordered a second time
        suffix = self.library.model.end_of_word_suffix
        self.special = Specials([{"content": t.content, "id": i} for i, t in self.library.get_added_tokens_decoder().items()])
        self.ends = np.zeros(self.library.get_vocab_size(), bool)  # tokens that end a piece
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(suffix)]] = True
        super().__init__(self._encoded)

    def _encoded(self, piece: str) -> list[int]:
        return self.library.encode(piece, add_special_tokens=False).ids

    def encoded(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of each of the pieces, many in one call; they stand apart, as in lower case a text could spell a special string."""
        for at in range(0, len(pieces), 5_000):
            [done] = self.library.encode_batch_fast([" ".join(pieces[at : at + 5_000])], add_special_tokens=False)
            ids = np.array(done.ids, "<u4")
            raw, before = ids.tobytes(), 0
            for stop in (4 * np.flatnonzero(self.ends[ids]) + 4).tolist():
                yield raw[before:stop]
                before = stop


@cache
def _library_at(path: str) -> LibraryChunks:
    return LibraryChunks(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _library_at(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for b in sliced(batches, 1500):
            cols: list[list[int]] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), seen.of_texts([parts_of(t, seen.special) for t in b.column(1).to_pylist()]), strict=True):
                raw = ids + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for col, v in zip(cols, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fixes bins that dominate all others with their largest item, and takes them from ``counts``.

    For a largest item w, no better bin exists than: w alone, if not even the smallest item
    joins it; w with the largest partner that fits, if that fills the bin, or if no two
    items fit beside w, or if at most two do and no pair of them outweighs that partner.
    """
    fixed: list[Pattern] = []
    sizes = sorted(w for w, n in counts.items() if n)

    def drop(w: int, n: int) -> None:
        counts[w] -= n
        if not counts[w]:
            sizes.pop(bisect_left(sizes, w))

    def smallest(k: int, but: int) -> list[int]:
        out: list[int] = []
        for w in sizes:
            out += [w] * min(k - len(out), counts[w] - (w == but))
            if len(out) == k:
                break
        return out

    def best_pair(room: int, but: int) -> int:
        own, best, hi = [w for w in sizes if w < room and counts[w] - (w == but) > 0], 0, 0
        hi = len(own) - 1
        for lo, a in enumerate(own):
            while hi >= lo and own[hi] + a > room:
                hi -= 1
            k = hi
            if k == lo and counts[a] - (a == but) < 2:
                k -= 1
            if k < lo:
                break
            best = max(best, a + own[k])
        return best

    for w in reversed(list(sizes)):
        while counts[w]:
            room = capacity - w
            few = smallest(3, w)
            if not few or few[0] > room:
                fixed.append((counts[w], [(w, 1)]))
                drop(w, counts[w])
                break
            at = bisect_left(sizes, room + 1) - 1
            if sizes[at] == w and counts[w] < 2:
                at -= 1
            mate = sizes[at]
            no_two = len(few) < 2 or few[0] + few[1] > room
            no_three = len(few) < 3 or sum(few) > room
            if not (mate == room or no_two or no_three and best_pair(room, w) <= mate):
                break
            n = counts[w] // 2 if mate == w else min(counts[w], counts[mate])
            if mate != room:
                n = 1 if not no_two else n  # what stands beside w may change once a mate is gone
            fixed.append((n, [(w, 2)] if mate == w else [(w, 1), (mate, 1)]))
            drop(w, 2 * n if mate == w else n)
            if mate != w:
                drop(mate, n)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by decreasing length; bins with the same content are one pattern."""
    bins: dict[int, list[Pattern]] = defaultdict(list)  # by the room that is left
    rooms: list[int] = []

    def put(room: int, n: int, content: list[tuple[int, int]]) -> None:
        if n:
            if not bins[room]:
                insort(rooms, room)
            bins[room].append((n, content))

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                put(capacity - each * w, left // each, [(w, each)])
                if left % each:
                    put(capacity - left % each * w, 1, [(w, left % each)])
                break
            room = rooms[at]
            n, content = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            each = room // w
            full = min(n, left // each)
            put(room - each * w, full, [*content, (w, each)])
            left -= full * each
            if full < n and left:
                put(room - left * w, 1, [*content, (w, left)])
                full, left = full + 1, 0
            put(room, n - full, content)
    return [p for room in rooms for p in bins[room]]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins for all items of the length table: reduction by dominance, then best fit of the rest."""
    rest = {w: n for w, n in counts.items() if n}
    fixed = reduce_by_dominance(rest, capacity)
    return fixed + best_fit({w: n for w, n in rest.items() if n}, capacity)


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, how many in a bin, first sequence, offset): where items go by rank."""
    rows, done, sequence = defaultdict(list), defaultdict(int), 0
    for n, content in patterns:
        offset = 0
        for w, each in content:
            rows[w].append((done[w], each, sequence, offset))
            done[w] += n * each
            offset += each * w
        sequence += n
    return {w: np.array(r, np.int64) for w, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    The pieces (five numbers each) are written once; only the table of lengths, of at most
    ``capacity`` rows, comes to the driver, and the plan that goes back has a row for each
    pattern and length in it.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, end_id))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = places(plan(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank_in_key"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            ends = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, ends) if len(order) else []:
                t, w = at[int(length[own[0]])], int(length[own[0]])
                row = t[np.searchsorted(t[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + nth // row[:, 1]
                offset[own] = row[:, 3] + nth % row[:, 1] * w
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = spread_rank(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
