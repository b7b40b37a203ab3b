"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

A task takes the documents of its partition slice by slice. The distinct pieces of a slice that
are not known yet form one sequence of byte ids; an inverted index leads from each mergeable
token pair to its positions. Merges are applied in rank order over all pieces at once, and a
merge looks up only the two pairs that it touched. Pieces are independent of each other, so
replaying a slice gives what replaying the whole corpus would.

Text is first cut at white space into chunks, of which few are distinct, and the split pattern
runs on new chunks only: a chunk is a run of white space with the following run of other
characters, and no match of the pattern crosses the end of a chunk.

Memory: one slice, and what the last `CACHE` to twice as many distinct chunks, and pieces, of the
tasks of a stage gave: the ids, and for the round trip their number, the ids as text, and the
bytes that decoding them gives, so that texts are put together chunk by chunk. Tasks of the next
stage drop it.

Defined results: null text counts as empty and gives no ids; ids that are null or outside the
vocabulary are an error on decoding; rows are independent, so repeated rows give equal results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridwarden.llm.common import as_texts, held, id_text, slices

CACHE = 250_000
# The code points of the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
DEAD, BORDER = -2, -1
NO_KEY = (1 << 63) - 1  # of no pair, after all others
SLICE = 4 << 20  # bytes
MANY = 400  # places of a rank that are worth arrays
# Ids, and for the round trip: number of ids, ids, ids as text, bytes they decode to.
Entry = bytes | tuple[int, bytes, str, bytes]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Recent(dict):
    """A table whose entries stay for one to two turns after their last use; a turn ends with
    more than `CACHE` entries."""

    def __init__(self):
        self.earlier: dict = {}

    def missing(self, keys: Iterable) -> list:
        """The keys without an entry; those with one have it in this turn from now on."""
        out, earlier = [], self.earlier.get
        for key in keys:
            if key not in self:
                found = earlier(key)
                if found is None:
                    out.append(key)
                else:
                    self[key] = found
        return out

    def turn(self) -> None:
        if len(self) > CACHE:
            self.earlier = dict(self)
            self.clear()


class MergeReplay:
    """Encoder and decoder for one rank table and split pattern; `both` if entries are to hold
    what a round trip needs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, both: bool = False):
        self.ranks, self.both = ranks, both
        self.token = {i: data for data, i in ranks.items()}
        self.digits = {i: str(i) for i in self.token}
        self.chunks, self.pieces = Recent(), Recent()
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.pairs = self._pairs()
        self.keys = np.array([*sorted(self.pairs), NO_KEY], np.int64)
        self.merged = np.array([*map(self.pairs.__getitem__, self.keys[:-1].tolist()), -1], np.int64)

    def _pairs(self) -> dict[int, int]:
        """All pairs of tokens that merge: to the id of the token, which is its rank."""
        known, pairs = self.ranks.get, {}
        for data, rank in self.ranks.items():
            for cut in range(1, len(data)):
                left = known(data[:cut])
                if left is not None:
                    right = known(data[cut:])
                    if right is not None:
                        pairs[left << 32 | right] = rank
        return pairs

    def _merged_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids that pairs merge to; -1 where they do not, or an id is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.merged[at], -1)

    def replay(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of every piece.

        `index` leads from the rank of a pair to its places. A rank with many places is merged
        at all pieces that have it once in one go, which no other place can disturb; other
        places are merged one after the other."""
        known = self.pairs.get
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        ends = np.cumsum(sizes)
        size = int(ends[-1]) if len(ends) else 0
        borders = np.zeros(size, bool)
        borders[ends - 1] = True
        view = np.full(size, BORDER, np.int32)
        view[~borders] = np.array(self.byte, np.int32)[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = array("i", view.tobytes())
        after = array("i", np.arange(1, size + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, size - 1, dtype=np.int32).tobytes())
        all_ids, all_after, all_before = (np.frombuffer(x, np.int32) for x in (ids, after, before)) if size else [view] * 3
        piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        index: dict[int, list[int]] = {}
        ranks: list[int] = []

        def enter(places: np.ndarray, found: np.ndarray) -> None:
            """Into the index, but for places without a rank."""
            has = np.flatnonzero(found >= 0)
            has = has[np.argsort(found[has], kind="stable")]
            found, places = found[has], places[has]
            starts = np.flatnonzero(np.diff(found, prepend=-1))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(found)]):
                rank = int(found[start])
                if rank in index:
                    index[rank] += places[start:stop].tolist()
                else:
                    index[rank] = places[start:stop].tolist()
                    heapq.heappush(ranks, rank)

        if size:
            enter(np.arange(size - 1), self._merged_all(all_ids[:-1], all_ids[1:]))
        while ranks:
            rank = heapq.heappop(ranks)
            places = index.pop(rank, None)
            if places is None:
                continue
            if len(places) >= MANY:
                at = np.sort(np.array(places, np.int32))
                at = at[(np.diff(at, prepend=-1) != 0) & (all_ids[at] >= 0)]
                gone = all_after[at]
                at = at[self._merged_all(all_ids[at], all_ids[gone]) == rank]
                other = np.diff(piece_of[at], prepend=-1, append=-1) != 0
                once = other[:-1] & other[1:]
                places = at[~once].tolist()
                at = at[once]
                gone = all_after[at]
                follow = all_after[gone]
                all_ids[at], all_ids[gone] = rank, DEAD
                all_after[at], all_before[follow] = follow, at
                ahead = all_before[at]
                left = np.where(ahead >= 0, all_ids[ahead], BORDER)
                new = self._merged_all(np.full(len(at), rank, np.int32), all_ids[follow])
                enter(at, new)
                enter(ahead, self._merged_all(left, np.full(len(at), rank, np.int32)))
            places.sort()
            for nth, at in enumerate(places):
                left = ids[at]
                if left < 0:
                    continue
                gone = after[at]
                right = ids[gone]
                if right < 0 or known(left << 32 | right) != rank:
                    continue  # a merge before this one changed the pair
                ids[at], ids[gone] = rank, DEAD
                follow = after[gone]
                after[at] = follow
                before[follow] = at
                lower = False
                right = ids[follow]
                if right >= 0:
                    new = known(rank << 32 | right)
                    if new is not None:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(ranks, new)
                        lower = new < rank
                ahead = before[at]
                if ahead >= 0 and ids[ahead] >= 0:
                    new = known(ids[ahead] << 32 | rank)
                    if new is not None:
                        if new in index:
                            index[new].append(ahead)
                        else:
                            index[new] = [ahead]
                            heapq.heappush(ranks, new)
                        lower = lower or new < rank
                if lower:  # the new pair goes first
                    index[rank] = index.get(rank, []) + places[nth + 1 :]
                    heapq.heappush(ranks, rank)
                    break
        kept = all_ids[all_ids >= 0]
        counts = np.bincount(piece_of[all_ids >= 0], minlength=len(pieces))
        stops = np.cumsum(counts).tolist()
        flat = kept.tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *stops], stops)]

    def _entry(self, ids: tuple[int, ...]) -> Entry:
        data = array("i", ids).tobytes()
        if not self.both:
            return data
        if len(ids) == 1:
            return 1, data, self.digits[ids[0]], self.token[ids[0]]
        return len(ids), data, self.joined(ids), self.decode(ids)

    def _learn(self, chunks: list[str]) -> None:
        """Give new chunks their entries."""
        cut = [self.split(c) for c in chunks]
        open_ = []
        for piece in self.pieces.missing(set(chain.from_iterable(cut))):
            whole = self.ranks.get(piece.encode())
            if whole is not None:
                self.pieces[piece] = self._entry((whole,))
            else:
                open_.append(piece)
        for piece, ids in zip(open_, self.replay([p.encode() for p in open_])):
            self.pieces[piece] = self._entry(ids)
        for chunk, parts in zip(chunks, cut):
            if len(parts) == 1:
                self.chunks[chunk] = self.pieces[parts[0]]
            elif not self.both:
                self.chunks[chunk] = b"".join(map(self.pieces.__getitem__, parts))
            else:
                counts, ids, texts, data = zip(*map(self.pieces.__getitem__, parts))
                self.chunks[chunk] = sum(counts), b"".join(ids), " ".join(texts), b"".join(data)
        self.pieces.turn()

    def entries(self, texts: list[str]) -> Iterator[list[Entry]]:
        """The entries of the chunks of each text."""
        cut = [CHUNK.findall(t) for t in texts]
        self._learn(self.chunks.missing(set(chain.from_iterable(cut))))
        lookup = self.chunks.__getitem__
        for chunks in cut:
            yield list(map(lookup, chunks))
        self.chunks.turn()

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for entries in self.entries(texts):
            yield array("i", b"".join([e[1] for e in entries] if self.both else entries)).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def joined(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


def _replayer(path: str, pattern: str, both: bool = False) -> MergeReplay:
    return MergeReplay(read_ranks(path), pattern, both)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(_replayer, path, pattern)
        for part in slices(batches, SLICE):
            ids = list(map(b"".join, coder.entries(as_texts(part))))
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            lists = pa.ListArray.from_arrays(
                pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32))
            )
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (bytes) of every row of doc_id, ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(_replayer, path, pattern)
        for batch in batches:
            data = [coder.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"]
            )

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode in one pass over the texts: doc_id, n_tokens, ids_sha256,
    decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(_replayer, path, pattern, True)
        for part in slices(batches, 2 * SLICE):  # the larger, the more places has a rank
            counts, of_ids, of_data = [], [], []
            for entries in coder.entries(as_texts(part)):
                number, _, texts, data = zip(*entries) if entries else ((), (), (), ())
                counts.append(sum(number))
                of_ids.append(hashlib.sha256(" ".join(texts).encode()).hexdigest())
                of_data.append(hashlib.sha256(b"".join(data)).hexdigest())
            doc_ids = part.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_data)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
