"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class).

The first factor is a softmax over `CLASSES` classes of a sum of weight rows, one for each
feature of the context: the word before, the word before that (a skip feature), both together,
and a constant. Features are hashed into a table of fixed size. The second factor is the
smoothed share of a word within its class. Frequent words are spread over half of the classes,
so most of these are nearly single words; all others go by their ending; the end of a text is a
class of its own. A word that was not seen in training is one more word of the class of its
ending, and classes of frequent words that hold none have no share, so probabilities add up to one.

Training: tasks take the weights, run stochastic gradient steps over the training tokens of
their blocks, and the results are averaged by tokens; `ROUNDS` rounds go over disjoint parts of
the blocks, so every training token is used once. Counts and class totals come from the whole
training part.

Texts are read once: a block (a bounded slice of documents) becomes one row with the numbers of
its words, and its distinct words are counted over all blocks: each block sends its sorted
hashes, packed, to the parts of the hash range, and each part sends the totals back in the same
order. A word is sent once a block, however frequent it is, and the number of parts follows that
of the words sent. Words are told apart by 64-bit hashes.

Defined results: null and empty texts consist of the end token; rows without an id are used for
training; repeated rows count repeatedly; without training tokens all words are unknown and
the model is uniform over the classes that can hold a word; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwarden.llm.common import alone, as_bytes, id_text, sized, slices
from gridwarden.session import written

CLASSES = 64
COMMON = 32  # classes of frequent words
END = CLASSES - 1
FREQUENT = 2000  # a word with one in this many tokens is frequent
ROWS = (1 << 12, 1 << 12, 1 << 13)  # of the hashed features
TABLE = 1 + sum(ROWS)
ROUNDS = 3
BATCH = 2048  # tokens a gradient step
SPAN = 1 << 16  # tokens whose features are computed at a time
RATE = 0.5
WORDS_A_PART = 1_000_000  # sent to a part of the hash range
CHUNKS = 16  # parts in which weights are averaged
BLOCKS = (
    "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, codes binary, "
    "words array<long>, endings array<byte>, counts array<long>"
)
COUNTED = (
    "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, codes binary, "
    "marks array<int>, facts array<long>"
)


def is_held_out(doc_id: int | None, divisor: int = 5, remainder: int = 1) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % divisor == remainder


def _list(values, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _squeeze(codes: np.ndarray) -> bytes:
    """Word numbers in a few bits each: frequent words have small ones, so that of four byte
    planes two or three are nearly empty."""
    planes = np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(codes).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _stretch(data: bytes) -> np.ndarray:
    count = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * count, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, count).T).view("<i4")[:, 0]


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def _blocks(docs: DataFrame) -> DataFrame:
    """One row a block: its documents as numbers of its distinct words, and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column("doc_id")
            held = [is_held_out(i) for i in ids.to_pylist()]
            codes, flat, ends = Numbers(), array("i"), []
            for text in as_bytes(part):
                flat.extend(map(codes.__getitem__, text.lower().split()))  # of bytes: A-Z, ASCII white space
                ends.append(len(flat))
            lengths = np.diff(np.array(ends, dtype=np.int32), prepend=np.int32(0))
            flat = np.frombuffer(flat, np.int32)
            # Numbers by falling frequency.
            order = np.argsort(-np.bincount(flat, minlength=len(codes)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            flat, names = rank[flat], list(codes)
            names = [names[i] for i in order.tolist()]
            words = np.array([xxhash.xxh64_intdigest(w) for w in names], dtype=np.uint64).view(np.int64)
            endings = np.array([zlib.crc32(w[-2:]) % (END - COMMON) for w in names], dtype=np.int8)
            used = flat[np.repeat(~np.array(held, dtype=bool), lengths)]
            counts = np.bincount(used, minlength=len(codes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().int >> 65], pa.int64()),
                    _list(ids, pa.int64()), _list(held, pa.bool_()), _list(lengths, pa.int32()),
                    pa.array([_squeeze(flat)], pa.binary()),
                    _list(words, pa.int64()), _list(endings, pa.int8()), _list(counts, pa.int64()),
                ],
                names=["block", "doc_ids", "held", "lengths", "codes", "words", "endings", "counts"],
            )

    return written(docs.mapInArrow(run, BLOCKS), "lm-blocks")


def _counted(blocks: DataFrame) -> DataFrame:
    """Blocks with a mark (31 bits of the hash) and the training count, ending and first block of
    each of their words, in the order of the words' numbers."""
    sent = blocks.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), sent // WORDS_A_PART)
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(batches):
            for block, words, counts in zip(*(batch.column(c) for c in ("block", "words", "counts"))):
                words = words.values.to_numpy().view(np.uint64)
                order = np.argsort(words)
                ends = np.searchsorted(words[order], bounds)
                pieces = zip(np.split(words[order], ends), np.split(counts.values.to_numpy()[order], ends))
                rows = [
                    (nth, _planes(np.diff(w, prepend=np.uint64(0))), _planes(n))
                    for nth, (w, n) in enumerate(pieces) if len(w)
                ]
                nth, hashes, n = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nth, pa.int32()), pa.array([block.as_py()] * len(rows), pa.int64()),
                        pa.array(hashes, pa.binary()), pa.array(n, pa.binary()),
                    ],
                    names=["nth", "block", "words", "counts"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in alone(batches):
            for nth, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.setdefault(nth, []).append(row)
        for nth, rows in held.items():
            rows.sort()
            words = np.concatenate([np.cumsum(_numbers(w), dtype=np.uint64) for _, w, _ in rows])
            counts = np.concatenate([_numbers(n).view(np.int64) for _, _, n in rows])
            _, first, place = np.unique(words, return_index=True, return_inverse=True)
            sums = np.zeros(len(first), np.int64)
            np.add.at(sums, place, counts)
            facts = sums[place] * 2
            facts[first] += 1
            ends = np.cumsum([len(w) // 8 for _, w, _ in rows])
            for (block, _, _), part in zip(rows, np.split(facts, ends[:-1])):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()), pa.array([nth], pa.int32()),
                        pa.array([_planes(part)], pa.binary()),
                    ],
                    names=["block", "nth", "facts"],
                )

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(batches):
            marks, facts = [], []
            for words, endings, found in zip(*(batch.column(c) for c in ("words", "endings", "found"))):
                words = words.values.to_numpy()
                mine = np.zeros(len(words), np.int64)
                if len(words):
                    pieces = sorted((f["nth"], f["facts"]) for f in found.as_py())
                    mine[np.argsort(words.view(np.uint64))] = np.concatenate([_numbers(f) for _, f in pieces]).view(np.int64)
                marks.append((words & 0x7FFFFFFF).astype(np.int32))
                facts.append((mine >> 1) * 64 + endings.values.to_numpy().astype(np.int64) * 2 + (mine & 1))
            kept = ["block", "doc_ids", "held", "lengths", "codes"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(marks, pa.list_(pa.int32())), pa.array(facts, pa.list_(pa.int64())),
                ],
                names=[*kept, "marks", "facts"],
            )

    schema = "nth int, block long, words binary, counts binary"
    rows = blocks.select("block", "words", "counts").mapInArrow(send, schema).repartition(parts, "nth")
    back = rows.mapInArrow(total, "block long, nth int, facts binary").groupBy("block").agg(
        F.collect_list(F.struct("nth", "facts")).alias("found")
    )
    return written(blocks.drop("counts").join(back, "block", "left").mapInArrow(put, COUNTED), "lm-counted")


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, one plane a byte: planes of zeros take no room when compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


class Block:
    """One row of the counted blocks, with classes and context features of all tokens, unless only
    its words are asked for."""

    def __init__(self, batch: pa.RecordBatch, row: int, tokens: int, words_only: bool = False):
        def column(name: str) -> np.ndarray:
            return batch.column(name)[row].values.to_numpy(zero_copy_only=False)

        hashes, facts = column("marks").astype(np.int64), column("facts")
        self.c, ending, self.first = facts >> 6, facts >> 1 & 31, (facts & 1).astype(bool)
        frequent = (self.c > 0) & (self.c * FREQUENT >= tokens)
        self.word_class = np.where(frequent, hashes % COMMON, COMMON + ending)
        if words_only:
            return
        self.doc_ids = batch.column("doc_ids")[row].values
        self.held = column("held").astype(bool)
        lengths = column("lengths").astype(np.int64)
        codes = _stretch(batch.column("codes")[row].as_py())
        # An end token after every document.
        self.sizes = lengths + 1
        self.ends = np.cumsum(self.sizes)
        is_word = np.ones(int(self.ends[-1]), bool)
        is_word[self.ends - 1] = False
        self.code = np.full(len(is_word), -1, np.int32)
        self.code[is_word] = codes
        self.classes = np.full(len(is_word), END, np.int8)
        self.classes[is_word] = self.word_class.astype(np.int8)[codes]
        mark = np.full(len(is_word), 0x1234567, np.int32)
        mark[is_word] = hashes.astype(np.int32)[codes]
        first = self.ends - self.sizes
        one, two = np.roll(mark, 1), np.roll(mark, 2)
        one[first] = 1
        two[first] = 2
        two[first[self.sizes > 1] + 1] = 2
        self.features = np.empty((3, len(is_word)), np.int32)
        self.features[0] = 1 + one % ROWS[0]
        self.features[1] = 1 + ROWS[0] + two % ROWS[1]
        for start in range(0, len(mark), SPAN):  # the products need 64 bits
            at = slice(start, start + SPAN)
            both = (one[at] * np.int64(0x9E3779B1) + two[at] * np.int64(0x85EBCA6B)) >> 13
            self.features[2, at] = 1 + ROWS[0] + ROWS[1] + both % ROWS[2]


def _log_shares(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(class | context), a row a token."""
    total = weights.take(features[0], axis=0)
    total += weights[0]
    for feature in features[1:]:
        total += weights.take(feature, axis=0)
    total -= total.max(axis=1, keepdims=True)
    total -= np.log(np.exp(total).sum(axis=1, keepdims=True))
    return total


def _step(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, sums: np.ndarray) -> None:
    squares[rows] += (sums * sums).mean(axis=1)
    weights[rows] -= RATE * sums / np.sqrt(squares[rows])[:, None]


def _descend(weights: np.ndarray, squares: np.ndarray, block: Block) -> int:
    """Adagrad steps over the training tokens of a block; how many there were."""
    used = np.flatnonzero(~np.repeat(block.held, block.sizes))
    for start in range(0, len(used), BATCH):
        at = used[start : start + BATCH]
        features = block.features[:, at]
        slope = _log_shares(weights, features)
        np.exp(slope, out=slope)
        slope[np.arange(len(at)), block.classes[at]] -= 1
        for feature in features:
            order = np.argsort(feature.astype(np.uint16), kind="stable")  # numpy sorts 16 bits by radix
            ranked = feature[order]
            firsts = np.flatnonzero(np.diff(ranked, prepend=-1))
            sums = np.add.reduceat(slope.take(order, axis=0), firsts, axis=0)
            _step(weights, squares, ranked[firsts], sums)
        _step(weights, squares, np.zeros(1, np.int64), slope.sum(axis=0, keepdims=True))
    return len(used)


def _train_round(blocks: DataFrame, weights: np.ndarray, tokens: int) -> np.ndarray:
    """The weights after each task has gone over its blocks, averaged by training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, squares, seen = weights.copy(), np.full(TABLE, 1.0, np.float32), 0
        for batch in alone(batches):
            for row in range(batch.num_rows):
                seen += _descend(mine, squares, Block(batch, row, tokens))
        if seen:  # changes as 16-bit numbers: they are what is shuffled, and many rows have none
            for chunk, part in enumerate(np.array_split(mine - weights, CHUNKS)):
                yield _chunk(chunk, seen, part.astype(np.float16))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in alone(batches):
            for chunk, seen, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                before = sums.get(chunk, (0, 0.0))
                mine = np.frombuffer(data, np.float16).astype(np.float64) * seen
                sums[chunk] = before[0] + seen, before[1] + mine
        for chunk, (seen, total) in sums.items():
            yield _chunk(chunk, seen, (total / seen).astype(np.float32))

    schema = "chunk int, seen long, data binary"
    parts = blocks.mapInArrow(run, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema).collect()
    if not parts:
        return weights
    changes = [np.frombuffer(p.data, np.float32) for p in sorted(parts, key=lambda p: p.chunk)]
    return weights + np.concatenate(changes).reshape(weights.shape)


def _chunk(chunk: int, seen: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int32()), pa.array([seen], pa.int64()), pa.array([data.tobytes()], pa.binary())],
        names=["chunk", "seen", "data"],
    )


def _class_totals(blocks: DataFrame, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training words of every class, but for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CLASSES), np.int64)
        for batch in alone(batches):
            for row in range(batch.num_rows):
                block = Block(batch, row, tokens, words_only=True)
                known = block.first & (block.c > 0)
                sums[1] += np.bincount(block.word_class[known], minlength=CLASSES)
                sums[0] += np.bincount(
                    block.word_class[known], weights=block.c[known], minlength=CLASSES
                ).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CLASSES), pa.int32()), pa.array(sums[0]), pa.array(sums[1])],
            names=["class", "tokens", "types"],
        )

    found = blocks.mapInArrow(run, "class int, tokens long, types long").groupBy("class").agg(
        F.sum("tokens").alias("tokens"), F.sum("types").alias("types")
    )
    totals, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for row in found.collect():
        totals[row["class"]], types[row["class"]] = row.tokens, row.types
    return totals, types


def _class_sizes(totals: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Smoothed sizes of the classes; those of endings have one more word, any unseen one."""
    unseen = np.arange(CLASSES) >= COMMON
    return totals + 0.5 * (types + unseen)


def _first_weights(class_size: np.ndarray) -> np.ndarray:
    """No knowledge of context; classes without a word, seen or not, have no share."""
    weights = np.zeros((TABLE, CLASSES), dtype=np.float32)
    weights[0, class_size == 0] = -1e4
    return weights


def _token_scores(block: Block, c: np.ndarray, weights: np.ndarray, class_size: np.ndarray) -> np.ndarray:
    """log10 P of every token of a block, given those before it; c: its training count."""
    with np.errstate(divide="ignore"):
        inside = np.where(block.code < 0, 0.0, np.log10((c + 0.5) / class_size[block.classes]))
    outer = np.empty(len(c))
    for start in range(0, len(c), 4 * BATCH):
        at = slice(start, start + 4 * BATCH)
        shares = _log_shares(weights, block.features[:, at])
        outer[at] = shares[np.arange(len(shares)), block.classes[at]]
    return inside + outer / np.log(10)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Train on the documents that are not held out and score all: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score (both log10 of the probability of the text)."""
    sized(docs.sparkSession)
    raw = _blocks(id_text(docs, id_col, text_col))
    used = raw.select(
        F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("words"),
        F.expr("size(filter(held, x -> NOT x))").cast("long").alias("ends"),
    ).agg(F.sum("words"), F.sum("ends")).first()
    words, ends = used[0] or 0, used[1] or 0
    tokens = words + ends
    blocks = _counted(raw)
    totals, types = _class_totals(blocks, tokens)
    distinct = int(types.sum()) + (ends > 0)
    class_total = _class_sizes(totals, types)
    weights = _first_weights(class_total)
    for nth in range(rounds):
        mine = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == nth)
        weights = _train_round(mine, weights, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_total = tokens + 0.5 * (distinct + 1)
        for batch in alone(batches):
            for row in range(batch.num_rows):
                block = Block(batch, row, tokens)
                c = np.where(block.code < 0, ends, block.c[block.code] if len(block.c) else 0)
                base = np.log10((c + 0.5) / base_total)
                own = _token_scores(block, c, weights, class_total)
                starts = block.ends - block.sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        block.doc_ids, pa.array(block.held), pa.array(block.sizes),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                        pa.array(np.full(len(starts), tokens, np.int64)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(own, starts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return blocks.mapInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
