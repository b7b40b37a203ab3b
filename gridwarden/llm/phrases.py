"""Phrase collocations: adjacent pairs of frequency-ranked ids, counted in tiles, level by level.

A task turns its documents into blocks of at most about `BLOCK` tokens, one row each: the tokens
as numbers of the block's own dictionary, and that dictionary with counts. Summed over all blocks
it gives the words; the frequent ones get ids by language and falling frequency, which go back to
the blocks through their dictionaries. Adjacent ids of a block are pairs. A pair's place is the tile of its two ranks and its address there: tiles that
hold many pairs, those of the first ranks of each language, are counted by one dense bincount
over their addresses, the others as sorted coordinates. Tasks add up the pairs of their blocks, a
bounded number at a time, and deal the sums by the hash of the pair to parts of bounded size; what
is added up there gives the frequent pairs, which are ranked again and replace the ids: two adjacent pairs that overlap in a word are
a phrase of three, two of those a phrase of four, by the same step. A phrase can only be frequent
if both are, so nothing is lost; ids without an adjacent id are dropped from the blocks.

A block ends between pieces, so that no pair is cut; a huge text is dealt to several, but for a
single piece of any length. What meets in one task: a block, or the sums of keys dealt by their
hash. The ids of frequent words or pairs go to the blocks by a broadcast if they are counted small,
else by a join through the blocks' dictionaries and pairs, so that no task needs all of them.

Blocks are rows of a few binaries, as Spark holds arrays of words or pairs at many times their
size; a file has few of them, since tasks read the row groups of a file whole.

Defined results: null text counts as empty, null language as `und`. Repeated rows count as often
as they occur. An empty table gives an empty result. Ids must be below 2**31 at every level.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.llm.common import alone, as_bytes, from_planes, planes, sized, slices
from gridwarden.operators.numbering import number_rows
from gridwarden.session import written

BLOCK = 500_000  # tokens
PART = 4 << 20  # bytes of text that are tokenized at a time
TILE_BITS = 9  # a tile has 512 x 512 addresses
DENSE_TILES = 8  # tiles counted densely at a time: 16 MB of counters
DENSE_SHARE = 16  # a tile is dense if it has a pair for every so many addresses
HELD_PAIRS = 1_000_000  # of several blocks, before a task adds them up
PAIRS_A_PART = 2_000_000
BLOCKS_A_FILE = 4
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20  # of the frequent words or pairs of one level

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
TABLE = LOWER.translate(bytes.maketrans(SEPARATORS + b"\t", b"." * len(SEPARATORS) + b" "))

# ids, lang_of (places in langs) and counts are planes, words are joined by blanks.
BLOCK_SCHEMA = "block long, ids binary, langs array<string>, lang_of binary, words binary, counts binary"
LEVEL_SCHEMA = "block long, ids binary"
ENTRY_SCHEMA = "block long, old long, lang string, word string, count long"


def _parts(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """Cut between words, if possible between pieces, and whether it is so."""
    start = 0
    while start < len(data):
        stop = start + PART
        end = data.find(b".", stop, stop + PART)
        if end < 0:
            ends = [e for e in (data.find(b" ", stop), data.find(b".", stop)) if e >= 0]
            end = min(ends, default=len(data)) if stop < len(data) else len(data)
        yield data[start:end], end == len(data) or data[end : end + 1] == b"."
        start = end


class _Block:
    def __init__(self):
        self.ids, self.size, self.number = [], 0, count()
        self.words: dict[str, defaultdict[bytes, int]] = {}

    def add(self, lang: str, part: bytes) -> None:
        if lang not in self.words:
            self.words[lang] = defaultdict(self.number.__next__, {b".": -1})
        tokens = part.replace(b".", b" . ").split()
        self.ids.append(np.fromiter(map(self.words[lang].__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)

    def row(self, number: int) -> pa.RecordBatch:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)
        langs, words = [], {}
        for lang, known in self.words.items():
            del known[b"."]
            words.update(zip(known.values(), zip([lang] * len(known), known)))
        langs = [words[i][0] for i in range(len(words))]
        texts = [words[i][1].decode("utf-8", "replace") for i in range(len(words))]
        counts = np.bincount(ids[ids >= 0], minlength=len(words))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
             pa.array([langs], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string())),
             pa.array([counts], pa.list_(pa.int64()))],
            names=["block", "ids", "langs", "words", "counts"],
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = count(TaskContext.get().partitionId() << 32)
    block = _Block()
    for batch in slices(batches, PART):
        by_lang = defaultdict(list)
        langs = pc.fill_null(batch.column("lang"), "und").to_pylist()
        for lang, text in zip(langs, as_bytes(batch)):
            by_lang[lang].append(text)
        for lang, texts in by_lang.items():
            for part, between in _parts(b".".join([b"", *texts, b""]).translate(TABLE)):
                block.add(lang, part)
                if between and block.size >= BLOCK:
                    yield block.row(next(number))
                    block = _Block()
    if block.size:
        yield block.row(next(number))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_blocks` without arrays that are as long as the block's dictionary."""
    for row in _blocks(batches):
        langs = row.column("langs")[0].values.dictionary_encode()
        counts = row.column("counts")[0].values.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [row.column("block"),
             pa.array([planes(np.frombuffer(row.column("ids")[0].as_py(), np.int32))], pa.binary()),
             pa.array([langs.dictionary], pa.list_(pa.string())),
             pa.array([planes(langs.indices.to_numpy().astype(np.int32))], pa.binary()),
             pc.binary_join(row.column("words"), " ").cast(pa.binary()),
             pa.array([planes(counts)], pa.binary())],
            names=["block", "ids", "langs", "lang_of", "words", "counts"],
        )


def _ids(batch: pa.RecordBatch, nth: int) -> np.ndarray:
    return from_planes(batch.column("ids")[nth].as_py(), np.int32)


def _dictionary(batch: pa.RecordBatch, nth: int) -> tuple[pa.Array, pa.Array]:
    """The languages and words of a block's numbers."""
    words = batch.column("words")[nth].as_py()
    lang_of = from_planes(batch.column("lang_of")[nth].as_py(), np.int32)
    langs = batch.column("langs")[nth].values
    return langs.take(pa.array(lang_of)), pa.array(words.split(b" ") if words else [], pa.binary()).cast(pa.string())


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in alone(batches):
        for nth in range(batch.num_rows):
            langs, words = _dictionary(batch, nth)
            blocks = np.full(len(words), batch.column("block")[nth].as_py(), np.int64)
            counts = from_planes(batch.column("counts")[nth].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks), pa.array(np.arange(len(words))), langs, words, pa.array(counts)],
                names=["block", "old", "lang", "word", "count"],
            )


def with_partners(ids: np.ndarray) -> np.ndarray:
    """Without ids that have no adjacent id, and with one -1 for any number of them."""
    known = np.concatenate([[False], ids >= 0, [False]])
    kept = np.where(known[1:-1] & (known[:-2] | known[2:]), ids, -1)
    before = np.concatenate([[-1], kept[:-1]])
    return kept[(kept >= 0) | (before >= 0)]


def pair_counts(ids: np.ndarray, bits: int = TILE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Keys (left << 32 | right) of the adjacent pairs of ids, -1 being no id, and their numbers."""
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    left, right = ids[:-1][both].astype(np.int64), ids[1:][both].astype(np.int64)
    if not len(left):
        return left, left
    across = (int(max(left.max(), right.max())) >> bits) + 1
    tile = (left >> bits) * across + (right >> bits)
    if across * across <= 1 << 22:
        held = np.bincount(tile, minlength=across * across)
        tiles = np.arange(len(held))
    else:
        tiles, held = np.unique(tile, return_counts=True)
    dense = tiles[np.argsort(-held, kind="stable")[:DENSE_TILES]]
    dense = np.sort(dense[held[np.searchsorted(tiles, dense)] >= (1 << 2 * bits) // DENSE_SHARE])
    keys, counts = [], []
    slot = np.searchsorted(dense, tile)
    in_dense = np.zeros(len(tile), bool)
    if len(dense):
        in_dense = dense[np.minimum(slot, len(dense) - 1)] == tile
        mask = (1 << bits) - 1
        address = (slot << 2 * bits) + ((left & mask) << bits) + (right & mask)
        cells = np.bincount(address[in_dense], minlength=len(dense) << 2 * bits)
        at = np.flatnonzero(cells)
        first = dense[at >> 2 * bits]
        row = (first // across << bits) + (at >> bits & mask)
        keys.append((row << 32) + (first % across << bits) + (at & mask))
        counts.append(cells[at])
    sparse, times = np.unique((left[~in_dense] << 32) + right[~in_dense], return_counts=True)
    return np.concatenate([*keys, sparse]), np.concatenate([*counts, times])


def next_ids(ids: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every two neighbours the value of their key, or -1. Keys are sorted."""
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    found = np.where(both, (ids[:-1].astype(np.int64) << 32) + ids[1:], -1)
    if not len(keys):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, values[at], -1)


def _level_row(number: int, ids: np.ndarray) -> pa.RecordBatch:
    data = planes(with_partners(ids).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["block", "ids"])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, none of them negative, in order, and the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")  # merges runs that are sorted
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def _dealt(keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part of the sorted keys: their gaps, and counts."""
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    nth = (mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    nth = nth.astype(np.uint16 if parts <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
    order = np.argsort(nth, kind="stable")
    keys, counts, nth = keys[order], counts[order], nth[order].astype(np.int32)
    starts = np.flatnonzero(np.diff(nth, prepend=-1))
    ends = np.append(starts[1:], len(nth))
    return pa.RecordBatch.from_arrays(
        [pa.array(nth[starts]),
         pa.array([planes(np.diff(keys[a:b], prepend=0)) for a, b in zip(starts, ends)], pa.binary()),
         pa.array([planes(counts[a:b]) for a, b in zip(starts, ends)], pa.binary())],
        names=["nth", "keys", "counts"],
    )


def _pair_sums(blocks: DataFrame, least: int, tokens: int) -> DataFrame:
    """key, n of the pairs that occur at least so often. `tokens` bounds the ids of all blocks."""
    wanted = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(wanted, tokens // PAIRS_A_PART)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in alone(batches):
            for nth in range(batch.num_rows):
                of_block = pair_counts(_ids(batch, nth))
                keys.append(of_block[0])
                counts.append(of_block[1])
                held += len(of_block[0])
                if held >= HELD_PAIRS:
                    yield _dealt(*_summed(keys, counts), parts)
                    keys, counts, held = [], [], 0
        if held:
            yield _dealt(*_summed(keys, counts), parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, counts = None, [], []

        def frequent() -> pa.RecordBatch:
            found, n = _summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(found[n >= least]), pa.array(n[n >= least])], names=["key", "n"])

        for batch in alone(batches):
            for nth in range(batch.num_rows):
                part, gaps, n = (batch.column(i)[nth].as_py() for i in range(3))
                if part != current:
                    if keys:
                        yield frequent()
                    current, keys, counts = part, [], []
                keys.append(np.cumsum(from_planes(gaps, np.int64)))
                counts.append(from_planes(n, np.int64))
        if keys:
            yield frequent()

    rows = blocks.select("block", "ids").mapInArrow(gather, "nth int, keys binary, counts binary")
    return rows.repartition(parts, "nth").sortWithinPartitions("nth").mapInArrow(add, "key long, n long")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in alone(batches):
        for nth in range(batch.num_rows):
            keys, _ = pair_counts(_ids(batch, nth))
            blocks = np.full(len(keys), batch.column("block")[nth].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(keys)], names=["block", "old"])


def _renumbered(ids: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Numbers of the block's dictionary as ids; -1 for those without."""
    table = np.full(max(ids.max(initial=-1), old.max(initial=-1)) + 2, -1)
    table[old] = new
    return table[ids]


def _recode(words: bool) -> Callable:
    """A block with new ids; `found` maps its dictionary numbers, or pairs, to them."""

    def recode(block: pa.Table, found: pa.Table) -> pa.Table:
        (row,) = block.combine_chunks().to_batches()
        found = found.sort_by("old")
        old, new = (found.column(c).to_numpy() for c in ("old", "id"))
        ids = _ids(row, 0)
        ids = _renumbered(ids, old, new) if words else next_ids(ids, old, new)
        return pa.Table.from_batches([_level_row(row.column("block")[0].as_py(), ids)])

    return recode


def _names(langs: pa.Array, words: pa.Array) -> pa.Array:
    """Words have no blanks, so the last one parts the two."""
    return pc.binary_join_element_wise(langs, words, " ")


def _recode_words(known: Broadcast) -> Callable:
    """known: the names of words, and their ids with -1 at the end."""

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = known.value
        for batch in alone(batches):
            for nth in range(batch.num_rows):
                at = pc.fill_null(pc.index_in(_names(*_dictionary(batch, nth)), value_set=names), -1).to_numpy()
                ids = _renumbered(_ids(batch, nth), np.arange(len(at)), values[at])
                yield _level_row(batch.column("block")[nth].as_py(), ids)

    return recode


def _recode_pairs(pairs: Broadcast) -> Callable:
    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(batches):
            for nth in range(batch.num_rows):
                yield _level_row(batch.column("block")[nth].as_py(), next_ids(_ids(batch, nth), *pairs.value))

    return recode


def _if_small(known: DataFrame) -> pa.Table | None:
    """A table of at most `BROADCAST_ROWS` rows and `BROADCAST_BYTES`, or None."""
    if known.count() > BROADCAST_ROWS:
        return None
    table = known.toArrow()
    return table if table.nbytes <= BROADCAST_BYTES else None


def _blocks_of(rows: DataFrame, name: str) -> DataFrame:
    return written(rows, name, rows_per_file=BLOCKS_A_FILE)


def _next_blocks(blocks: DataFrame, found: DataFrame, words: bool, name: str) -> DataFrame:
    """found: block, old, id; one row a frequent entry of a block, so at most its tokens."""
    both = blocks.select("block", "ids").groupBy("block").cogroup(found.groupBy("block"))
    return _blocks_of(both.applyInArrow(_recode(words), LEVEL_SCHEMA), name)


def _first_level(blocks: DataFrame, entries: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Blocks in ids of words. known: lang, word, id."""
    small = _if_small(known)
    if small is None:
        found = entries.join(known, ["lang", "word"]).select("block", "old", "id")
        return _next_blocks(blocks, found, True, name)
    names = _names(*(small.column(c).combine_chunks().cast(pa.string()) for c in ("lang", "word")))
    values = np.append(small.column("id").to_numpy(), -1)
    names = blocks.sparkSession.sparkContext.broadcast((names, values))
    rows = blocks.select("block", "ids", "langs", "lang_of", "words")
    return _blocks_of(rows.mapInArrow(_recode_words(names), LEVEL_SCHEMA), name)


def _next_level(blocks: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Blocks in ids of the pairs of their ids. known: old (the key of the pair), id."""
    small = _if_small(known)
    if small is None:
        pairs = blocks.mapInArrow(_pairs, "block long, old long")
        return _next_blocks(blocks, pairs.join(known, "old").select("block", "old", "id"), False, name)
    pairs = small.sort_by("old")
    arrays = tuple(pairs.column(c).to_numpy() for c in ("old", "id"))
    rows = blocks.mapInArrow(_recode_pairs(blocks.sparkSession.sparkContext.broadcast(arrays)), LEVEL_SCHEMA)
    return _blocks_of(rows, name)


def _checked(units: DataFrame) -> DataFrame:
    if (units.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more frequent phrases of one length than ids")
    return units


def _next_units(blocks: DataFrame, units: DataFrame, least: int, tokens: int, name: str) -> DataFrame:
    """The frequent pairs of units: id, lang, n, words, and the counts of all heads and tails."""
    pairs = written(_pair_sums(blocks, least, tokens), "phrase-pairs")
    pairs = pairs.selectExpr("key", "shiftright(key, 32) AS left", "key & 4294967295 AS right", "n")
    heads = units.select(F.col("id").alias("left"), "lang", F.col("words").alias("w"), F.col("heads").alias("h"))
    tails = units.select(F.col("id").alias("right"), F.element_at("words", -1).alias("last"), F.col("tails").alias("t"))
    joined = pairs.join(heads, "left").join(tails, "right").select(
        "key", "left", "right", "lang", "n", F.concat("w", F.array("last")).alias("words"),
        F.concat("h", F.array("n")).alias("heads"), F.concat("t", F.array("n")).alias("tails"),
    )
    order = [F.col("lang"), F.col("n").desc(), F.col("left"), F.col("right")]
    return _checked(written(number_rows(joined, order, "id", start=0), name))


def _scored(units: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the cut that scores lowest, the first of equal ones."""
    cuts = F.expr(
        "array_min(transform(sequence(1, size(words) - 1), i -> named_struct("
        "'score', (CAST(n AS DECIMAL(20, 0)) * 2000000) DIV "
        "(CAST(heads[i - 1] AS DECIMAL(20, 0)) + CAST(tails[size(words) - i - 1] AS DECIMAL(20, 0))), "
        "'i', i, 'l', heads[i - 1], 'r', tails[size(words) - i - 1])))"
    )
    return units.withColumn("cut", cuts).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"),
        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"),
    )


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text",
    least: int = 30, longest: int = 4, share: int = 80, top: int = 2_000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words
    that occur `least` times and not `share` per cent within a longer one."""
    source = docs.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    sized(docs.sparkSession)
    blocks = _blocks_of(source.mapInArrow(_packed, BLOCK_SCHEMA), "phrase-blocks")
    entries = blocks.mapInArrow(_entries, ENTRY_SCHEMA)
    words = written(entries.groupBy("lang", "word").agg(F.sum("count").alias("n")), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    tokens = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= least)
    units = number_rows(frequent, [F.col("lang"), F.col("n").desc(), F.col("word")], "id", start=0).select(
        "id", "lang", "n", F.array("word").alias("words"), F.array("n").alias("heads"), F.array("n").alias("tails")
    )
    units = _checked(written(units, "phrase-level-1"))
    known = units.select("lang", F.element_at("words", 1).alias("word"), "id")
    level, done = _first_level(blocks, entries, known, "phrase-blocks-1"), None
    for size in range(2, longest + 1):
        longer = _next_units(level, units, least, tokens, f"phrase-level-{size}")
        if size > 2:
            around = longer.selectExpr("explode(array(left, right)) AS id", "n AS around")
            around = around.groupBy("id").agg(F.max("around").alias("around"))
            kept = units.join(around, "id", "left").where(
                F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("n").cast("decimal(20,0)") * share)
            )
            done = _scored(kept) if done is None else done.unionByName(_scored(kept))
        if size < longest:
            level = _next_level(level, longer.select(F.col("key").alias("old"), "id"), f"phrase-blocks-{size}")
        units = longer
    done = _scored(units) if done is None else done.unionByName(_scored(units))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = done.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
        F.col("total").alias("n"), F.col("score").cast("long").alias("score"),
    )
