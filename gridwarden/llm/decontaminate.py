"""Benchmark decontamination by a positional inverted index over the training corpus.

The index is cut by documents: a shard is a bounded run of documents with the posting list of
every term in it, written once as a table with a file a shard. Searching sends test windows to the shards. For
each window whose terms all occur in a shard, the offset-adjusted posting lists are intersected
from the rarest term on, so most windows end at an empty or tiny list. What remains are exact
phrase matches; with `slop` they are ordered proximity matches, where up to `slop` other words
may stand between neighbouring words of the window.

The test set comes to the tasks in blocks of at most `block_bytes` of text, with one pass over
the index a block, so neither the driver nor a task ever holds more of it.

Defined results: null or empty texts have no words and no matches; rows are independent, and
repeated rows give equal results; test items without words have no window, items without an id
take no part; equal items match alike. A match never crosses the end of a document.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.common import alone, as_bytes, from_planes, id_text, planes, sized, slices
from gridwarden.session import broadcast_if_small, dropped, written

WINDOW = 10
BLOCK_BYTES = 16 << 20
HITS_BROADCAST = 200_000  # ids: under 4 MB
# Terms are joined by blanks; doc_ends, times and steps are planes of int32.
INDEX_SCHEMA = "shard string, doc_ids array<long>, doc_ends binary, terms binary, times binary, steps binary"
MATCHES = "matches array<struct<item_id: long, first: int, last: int>>"
# Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as a-z.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TO_WORDS).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write and return the index: one row a shard. Positions of a term are stored as steps."""
    sized(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            codes: defaultdict[bytes, int] = defaultdict(count().__next__)
            lists = [
                np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
                for words in map(words_of, as_bytes(part))
            ]
            ends = np.cumsum([len(w) for w in lists], dtype=np.int64)
            flat = np.concatenate(lists)
            order = np.argsort(flat, kind="stable").astype(np.int32)
            times = np.bincount(flat, minlength=len(codes))
            steps = np.diff(order, prepend=np.int32(0))
            firsts = np.cumsum(times) - times
            steps[firsts] = order[firsts]  # a list starts with its first position
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]),
                    pa.ListArray.from_arrays(
                        pa.array([0, part.num_rows], pa.int32()), part.column("doc_id")
                    ),
                    pa.array([planes(ends.astype(np.int32))], pa.binary()),
                    pa.array([b" ".join(codes)], pa.binary()),
                    pa.array([planes(times.astype(np.int32))], pa.binary()),
                    pa.array([planes(steps)], pa.binary()),
                ],
                names=["shard", "doc_ids", "doc_ends", "terms", "times", "steps"],
            )

    rows = id_text(docs, id_col, text_col).mapInArrow(run, INDEX_SCHEMA)
    return written(rows, "postings", rows_per_file=1)


class Windows:
    """The windows of one block of test items, as rows of term numbers by window length."""

    def __init__(self, items: list[tuple[int, bytes]], size: int):
        self.terms: dict[bytes, int] = {}
        rows: dict[int, list[list[int]]] = {}
        owners: dict[int, list[int]] = {}
        for item_id, text in items:
            words = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            length = min(size, len(words))
            for start in range(len(words) - length + 1 if length else 0):
                rows.setdefault(length, []).append(words[start : start + length])
                owners.setdefault(length, []).append(item_id)
        self.by_length = [
            (np.array(rows[n], dtype=np.int32), np.array(owners[n], dtype=np.int64)) for n in rows
        ]


class Shard:
    """Posting lists of the test terms in one shard."""

    def __init__(self, row: dict, terms: dict[bytes, int]):
        self.doc_ends = row["doc_ends"]
        self.lists: list[np.ndarray] = [np.empty(0, np.int32)] * len(terms)
        self.counts = np.zeros(len(terms), dtype=np.int64)
        steps, ends = row["steps"], np.cumsum(row["times"], dtype=np.int64)
        for nth, term in enumerate(row["terms"].split()):
            at = terms.get(term)
            if at is not None:
                start = ends[nth - 1] if nth else 0
                self.lists[at] = np.cumsum(steps[start : ends[nth]])
                self.counts[at] = len(self.lists[at])

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, positions, side="right")

    def phrases(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of the places where the words stand one after another."""
        order = np.argsort(self.counts[window], kind="stable")
        starts = self.lists[window[order[0]]] - order[0]
        for offset in order[1:]:
            other = self.lists[window[offset]]
            at = np.minimum(np.searchsorted(other, starts + offset), len(other) - 1)
            starts = starts[other[at] == starts + offset]
            if not len(starts):
                return starts, starts
        starts = starts[starts >= 0]
        lasts = starts + len(window) - 1
        inside = self.doc_of(starts) == self.doc_of(lasts)
        return starts[inside], lasts[inside]

    def near(self, window: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of the places where the words follow each other in order,
        each at most 1 + slop words after the one before. One place a first position."""
        reach = len(window) * (1 + slop)
        rarest = self.lists[window[np.argmin(self.counts[window])]]

        def close(positions: np.ndarray) -> np.ndarray:
            at = np.searchsorted(rarest, positions)
            right = rarest[np.minimum(at, len(rarest) - 1)]
            left = rarest[np.maximum(at - 1, 0)]
            return positions[np.minimum(abs(right - positions), abs(left - positions)) <= reach]

        def following(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
            """Which tails have a head at most 1 + slop before, in their document."""
            at = np.searchsorted(heads, tails, side="left") - 1
            head = heads[np.maximum(at, 0)]
            return (at >= 0) & (tails - head <= 1 + slop) & (self.doc_of(head) == self.doc_of(tails))

        chain = [close(self.lists[window[0]])]
        for term in window[1:]:
            tails = close(self.lists[term])
            chain.append(tails[following(chain[-1], tails)] if len(chain[-1]) else tails[:0])
            if not len(chain[-1]):
                return chain[-1], chain[-1]
        firsts = ends = chain[-1]  # the earliest end of the chain that begins at each position
        for heads in reversed(chain[:-1]):
            at = np.searchsorted(firsts, heads, side="right")
            tail = firsts[np.minimum(at, len(firsts) - 1)]
            good = (at < len(firsts)) & (tail - heads <= 1 + slop)
            good &= self.doc_of(heads) == self.doc_of(tail)
            firsts, ends = heads[good], ends[np.minimum(at, len(firsts) - 1)][good]
        return firsts, ends


def _search(row: dict, windows: Windows, slop: int) -> dict[int, dict[int, list[list[int]]]]:
    """document of the shard -> item -> merged runs of hit positions."""
    shard = Shard(row, windows.terms)
    hits: dict[int, dict[int, list[list[int]]]] = {}
    for rows, owners in windows.by_length:
        for nth in np.flatnonzero((shard.counts[rows] > 0).all(axis=1)):
            firsts, lasts = shard.near(rows[nth], slop) if slop else shard.phrases(rows[nth])
            item = int(owners[nth])
            for doc, first, last in zip(
                shard.doc_of(firsts).tolist(), firsts.tolist(), lasts.tolist()
            ):
                hits.setdefault(doc, {}).setdefault(item, []).append([first, last])
    for items in hits.values():
        for item, spans in items.items():
            merged: list[list[int]] = []
            for first, last in sorted(spans):
                if merged and first <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], last)
                else:
                    merged.append([first, last])
            items[item] = merged
    return hits


def _search_block(index: DataFrame, windows: Windows, slop: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(batches):
            for nth in range(batch.num_rows):
                row = {
                    name: from_planes(batch.column(name)[nth].as_py(), np.int32)
                    for name in ("doc_ends", "times", "steps")
                }
                row["terms"] = batch.column("terms")[nth].as_py()
                hits = _search(row, windows, slop)
                starts = np.concatenate([[0], row["doc_ends"][:-1]]).tolist()
                found = [
                    [
                        {"item_id": item, "first": a - starts[doc], "last": b - starts[doc]}
                        for item, spans in hits.get(doc, {}).items()
                        for a, b in spans
                    ]
                    for doc in range(len(starts))
                ]
                kind = pa.list_(
                    pa.struct([("item_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("shard")[nth].as_py()] * len(starts)),
                        pa.array(range(len(starts)), pa.int32()),
                        batch.column("doc_ids")[nth].values,
                        pa.array(np.diff(row["doc_ends"], prepend=0), pa.int64()),
                        pa.array(found, kind),
                    ],
                    names=["shard", "nth", "doc_id", "n_words", "matches"],
                )

    return index.mapInArrow(run, f"shard string, nth int, doc_id long, n_words long, {MATCHES}")


def search_index(
    index: DataFrame,
    items: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every document of the index: doc_id, n_words, matches (runs of hit words by item)."""
    items = items.select(
        F.col(f"`{item_col}`").cast("long").alias("item_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).where("item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    found = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        windows = Windows([(r.item_id, r.text.encode()) for r in rows], window)
        found.append(_search_block(index, windows, slop))
    if blocks == 1:
        return found[0].select("doc_id", "n_words", "matches")
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("shard", "nth")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("matches")).alias("matches"),
        )
        .select("doc_id", "n_words", "matches")
    )


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Index the documents and search the items in them: doc_id, n_words, matches."""
    return search_index(build_index(docs), items, **options)


def without_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The documents without a match, with all columns. Rows without an id are searched too and
    stay or go together, as rows that share an id do."""
    index = build_index(docs, id_col, text_col)
    found = search_index(index, items, **options)
    hit = written(
        found.where(F.size("matches") > 0).select(F.col("doc_id").alias("__hit")).distinct(), "hits"
    )
    dropped(index)
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__hit"))
    return docs.join(broadcast_if_small(hit, HITS_BROADCAST), same, "left_anti")


# Words in the union of the matches of a document.
N_HIT = """aggregate(
    array_sort(transform(matches, m -> struct(m.first AS first, m.last AS last))),
    struct(0L AS words, -1 AS upto),
    (a, m) -> struct(
        a.words + greatest(0, m.last - greatest(m.first - 1, a.upto)) AS words,
        greatest(a.upto, m.last) AS upto),
    a -> a.words)"""
ITEMS = "array_sort(array_distinct(transform(matches, m -> string(m.item_id))))"
