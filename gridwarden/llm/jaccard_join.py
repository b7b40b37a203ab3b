"""N-gram Jaccard join: all links between documents whose shingle sets are alike, as classes.

1. Every document becomes the sorted array of its distinct shingles (64-bit hashes). Documents
   with equal sets are one node from here on, so exact copies are never compared.
2. Size bands. Sizes are cut into bands so that linked sets lie in one band or in neighbouring
   ones. In a band, linked sets differ in at most D elements, so if the hash range is cut into
   more than D parts, some parts are equal in both sets. A node sends one key a part (band, part,
   contents) for its own band and the next. There are so many parts that nearly every node has
   fewer empty ones than linked sets have equal ones, so these make no keys; the exceptions
   send keys for empty parts, too. No link is lost.
   Shingles of lines and passages that very many documents share are left out of the parts,
   which keeps the argument, as it takes elements out of both sets alike. Nodes left with too
   many empty parts send a second family of keys, of all their shingles; a pair without an equal
   filled part in the first family meets in the second. What is frequent is told by a table of
   2^20 counters over all documents; any choice gives the same links.
3. The nodes of a key are tied to the least node of the key, never to each other. Connected
   nodes form a class of candidates; only such classes are compared. Classes too large for one
   tile, which are mostly documents of one subject chained by short parts, are cut first: their
   nodes are compared by sketches alone (a parity bitmap of one or two bits a shingle, which
   bounds the overlap from above), and only nodes that sketches connect stay in one class. No
   linked pair is cut, and texts are never dealt to more tiles than what is left needs.
4. Tiles. A class is cut into tiles of bounded size. Within a tile, nodes are compared in order
   of size; a parity bitmap of the shingles bounds the overlap from above
   (overlap <= (|A| + |B| - bits that differ) / 2), and what passes is decided by intersecting
   the sorted arrays. Nodes already connected are not compared again, so a group of near copies
   costs one comparison a node, not all pairs.
5. A class of several tiles is dealt anew once, and then its smaller components are compared
   with all of its tiles in blocks, which makes the result exact without any limit on partners.

Defined results: words are runs of anything but ASCII white space, A-Z count as a-z; with fewer
words than a shingle has, the whole sequence is the one shingle; null, empty or blank texts have
no shingles and are linked with nothing. Rows without an id are returned with a null component.
Rows that repeat an id count as documents of that id. Different shingles are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.common import as_bytes, id_text, join_split_hot, slices
from gridwarden.llm.components import components
from gridwarden.session import broadcast_if_small, dropped, shuffles_go, written

SLICE = 4 << 20  # bytes of text
TILE_SHINGLES = 500_000
TILE_ROWS = 256
SKETCH_SHINGLES = 4_000_000  # of the sketches of a tile, one or two bits each
SKETCH_ROWS = 2_048
COUNTERS = 1 << 20
COUNTER_PARTS = 32
FILTER_PARTS = 64
FILTER_BITS = 1 << 28  # 32 MB
PRINTS_A_PART = 4_000_000
MEMBERS_BROADCAST = 200_000  # rows of (long, long, long, int): under 8 MB


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    lists = [t.lower().split() for t in texts]  # of bytes: A-Z, and ASCII white space
    codes: dict[bytes, int] = {}
    for words in lists:
        for word in words:
            if word not in codes:
                codes[word] = xxhash.xxh64_intdigest(word)
    look = codes.__getitem__
    out = []
    for words in lists:
        hashes = np.fromiter(map(look, words), np.uint64, len(words))
        if not len(words):
            out.append(hashes)
            continue
        span = min(size, len(words))
        mixed = np.full(len(words) - span + 1, span, dtype=np.uint64)
        for k in range(span):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - span + 1 + k])
        out.append(np.unique(mixed))
    return out


def node_of(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)))


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parities of the counts of shingles with equal last bits: a power of two of them, one at
    least for each shingle. Halves that are folded on each other give the sketch of half as many."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, bits: int) -> np.ndarray:
    words = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)


class Bands:
    """Size bands and the parts of each, for links at shared / union >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        self.plans: dict[int, tuple[int, np.ndarray]] = {}

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def sizes(self, band: int) -> tuple[int, int]:
        """The least and the largest size in the band."""
        while len(self.edges) < band + 2:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return self.edges[band], self.edges[band + 1] - 1

    def plan(self, band: int) -> tuple[int, np.ndarray]:
        """The most elements in which linked sets of the tile differ, and where parts are cut."""
        if band not in self.plans:
            least, most = self.sizes(max(band - 1, 0))[0], self.sizes(band)[1]
            differ = 2 * most * (self.den - self.num) // (self.den + self.num)
            parts = differ + 2
            for _ in range(50):
                empty = parts * math.exp(-least / parts)  # as many empty parts are expected
                wanted = differ + max(2, math.ceil(empty + 3 * math.sqrt(empty) + 1))
                if wanted <= parts or 2 * wanted > least:
                    break
                parts = wanted
            cuts = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
            self.plans[band] = differ, cuts
        return self.plans[band]

    @staticmethod
    def _parts(shingles: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed contents of all parts, and which of them are filled."""
        sums = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(_mix(shingles ^ np.uint64(0xA5A5A5A5)), out=sums[1:])
        ends = np.concatenate([[0], np.searchsorted(shingles, cuts), [len(shingles)]])
        return np.diff(sums[ends]), np.diff(ends) > 0

    def keys(self, shingles: np.ndarray, rare: np.ndarray | None = None) -> np.ndarray:
        """Keys of one set. Linked sets share one at least, unless they are equal. `rare` are
        the shingles that are not frequent."""
        found = [np.empty(0, np.uint64)]
        own = self.band(len(shingles)) if len(shingles) else 0
        for band in (own, own + 1) if len(shingles) else ():
            differ, cuts = self.plan(band)
            if not differ:
                continue  # only equal sets are linked
            for family, some in enumerate((shingles if rare is None else rare, shingles)):
                content, filled = self._parts(some, cuts)
                bare = (~filled).sum() >= len(filled) - differ
                last = family == 1 or rare is None
                which = np.arange(len(filled)) if bare and last else np.flatnonzero(filled)
                place = which.astype(np.uint64) + np.uint64((2 * band + family) << 32)
                found.append(_mix(content[which] ^ _mix(place)))
                if last or not bare:
                    break
        return np.concatenate(found).view(np.int64)


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Which of `COUNTERS` hash values stand for shingles that very many documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for part in slices(batches, SLICE):
            sets = shingle_sets(as_bytes(part), size)
            at = np.concatenate([np.empty(0, np.uint64), *sets]) & np.uint64(COUNTERS - 1)
            counts += np.bincount(at.astype(np.int64), minlength=COUNTERS)
        for nth, part in enumerate(np.split(counts, COUNTER_PARTS)):  # a plane a byte, as far as filled
            planes = range(max(1, (int(part.max()).bit_length() + 7) // 8))
            yield _counter_row(nth, b"".join((part >> 8 * k).astype(np.uint8).tobytes() for k in planes))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for nth, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                planes = np.frombuffer(data, np.uint8).reshape(-1, COUNTERS // COUNTER_PARTS)
                sums[nth] = sums.get(nth, 0) + sum(p.astype(np.uint64) << np.uint64(8 * k) for k, p in enumerate(planes))
        for nth, total in sums.items():
            yield _counter_row(nth, total.tobytes())

    schema = "nth int, data binary"
    rows = docs.mapInArrow(run, schema).repartition(COUNTER_PARTS, "nth").mapInArrow(add, schema)
    parts = {r.nth: np.frombuffer(r.data, np.uint64) for r in rows.collect()}
    empty = np.zeros(COUNTERS // COUNTER_PARTS, np.uint64)
    counts = np.concatenate([parts.get(nth, empty) for nth in range(COUNTER_PARTS)])
    return counts > 64 + 4 * counts.mean()


def _counter_row(nth: int, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([nth], pa.int32()), pa.array([counts], pa.binary())], names=["nth", "data"]
    )


def _sets(docs: DataFrame, size: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, node, sketch and the keys of its set, the latter once a node and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for part in slices(batches, SLICE):
            ids = part.column("doc_id")
            nodes, counts, sketches, lengths, keys = [], [], [], [0], []
            for doc_id, shingles in zip(ids.to_pylist(), shingle_sets(as_bytes(part), size)):
                node = node_of(shingles)
                nodes.append(node)
                counts.append(len(shingles))
                sketches.append(sketch_of(shingles))
                if doc_id is not None and node not in seen:
                    seen.add(node)
                    rare = ~frequent[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    keys.append(bands.keys(shingles, shingles[rare]))
                    lengths.append(lengths[-1] + len(keys[-1]))
                else:
                    lengths.append(lengths[-1])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(counts, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "node", "sketch", "keys"],
            )

    schema = "doc_id long, n_shingles long, node long, sketch binary, keys array<long>"
    return docs.mapInArrow(run, schema)


def squeezed(values: np.ndarray) -> bytes:
    """Sorted numbers as gaps, one plane a byte: planes of zeros take no room when compressed."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _repeated_prints(sets: DataFrame) -> tuple[DataFrame, int]:
    """The prints (first bits, as a number) of keys that occur more than once, and how many bits
    they are cut by. A few other keys have a print that repeats."""
    total = sets.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = min(56, max(24, total.bit_length() + 8))
    cut = 64 - bits
    parts = max(FILTER_PARTS, total // PRINTS_A_PART)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.sort(batch.column("keys").flatten().to_numpy().view(np.uint64) >> np.uint64(cut))
            nth = (prints.astype(np.float64) * (parts / 2.0**bits)).astype(np.int64)  # rises with the print
            nth = np.minimum(nth, parts - 1)
            starts = np.flatnonzero(np.diff(nth, prepend=-1))
            pieces = np.split(prints, starts[1:]) if len(starts) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(nth[starts].astype(np.int32)), pa.array(map(squeezed, pieces), pa.binary())],
                names=["nth", "data"],
            )

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for nth, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(nth, []).append(unsqueezed(data))
        for pieces in held.values():
            prints, counts = np.unique(np.concatenate(pieces), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(prints[counts > 1].view(np.int64))], names=["key"])

    rows = sets.where("size(keys) > 0").select("keys").mapInArrow(gather, "nth int, data binary")
    return rows.repartition(parts, "nth").mapInArrow(repeated, "key long"), cut


def _shared_keys(sets: DataFrame) -> DataFrame:
    """(node, key) for all keys that occur more than once, and some others, written.

    Nearly all keys occur once. Sorted prints of the keys, two or three bytes each, are shuffled
    to find those that repeat; they are marked in a table of bits, by which the others are left
    out before nodes are shuffled. The table has 16 bits a repeated print, at most `FILTER_BITS`,
    so it has a fixed bound; where it is full it leaves more keys in, which changes no result.
    """
    prints, cut = _repeated_prints(sets)
    repeated = written(prints, "repeated-keys")
    bits = FILTER_PARTS * 64
    wanted = min(16 * repeated.count(), FILTER_BITS)
    while bits < wanted:
        bits *= 2
    part_bits = bits // FILTER_PARTS

    def places(prints: np.ndarray) -> np.ndarray:
        return (prints & np.uint64(bits - 1)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            at = places(batch.column("key").to_numpy().view(np.uint64))
            for nth in np.unique(at // part_bits).tolist():
                table = tables.setdefault(nth, np.zeros(part_bits, bool))
                table[at[at // part_bits == nth] % part_bits] = True
        for nth, table in tables.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([nth], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())],
                names=["nth", "data"],
            )

    nth = F.expr(f"CAST((key & {bits - 1}L) DIV {part_bits} AS INT)")
    parts = repeated.repartition(FILTER_PARTS, nth).mapInArrow(mark, "nth int, data binary").collect()
    marked = np.zeros(bits // 8, np.uint8)
    for row in parts:  # a part is marked by one task
        start = row.nth * part_bits // 8
        marked[start : start + part_bits // 8] = np.frombuffer(row.data, np.uint8)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy()
            nodes = np.repeat(batch.column("node").to_numpy(), lists.value_lengths().to_numpy())
            at = places(keys.view(np.uint64) >> np.uint64(cut))
            good = (marked[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[good]), pa.array(keys[good])], names=["node", "key"]
            )

    dropped(repeated)
    rows = sets.where("size(keys) > 0").select("node", "keys")
    return written(rows.mapInArrow(keep, "node long, key long"), "shared-keys")


def compare(
    nodes: list[int], sets: list[np.ndarray], labels: list[int], num: int, den: int
) -> list[tuple[int, int]]:
    """Links of a tile that connect nodes of different labels: a forest, not all links."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets, nodes = [sets[i] for i in order], [nodes[i] for i in order]
    numbers: dict[int, int] = {}
    label = np.array([numbers.setdefault(labels[i], len(numbers)) for i in order])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = 64
    while bits < min(4 * sizes[-1], 65_536):
        bits *= 2
    maps = np.zeros((len(sets), bits), dtype=np.uint8)
    for i, shingles in enumerate(sets):
        maps[i] = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    maps = np.packbits(maps, axis=1).view(np.uint64)
    links = []
    for i in range(1, len(sets)):
        low = int(np.searchsorted(sizes, -(-num * sizes[i] // den)))
        open_ = np.flatnonzero(label[low:i] != label[i]) + low
        if not len(open_):
            continue
        apart = np.bitwise_count(maps[open_] ^ maps[i]).sum(axis=1, dtype=np.int64)
        both = sizes[open_] + sizes[i]
        bound = np.minimum((both - apart) // 2, sizes[open_])
        good = bound * (num + den) >= num * both
        open_ = open_[good][np.argsort(-bound[good], kind="stable")]
        while len(open_):
            j = int(open_[0])
            at = np.minimum(np.searchsorted(sets[i], sets[j]), len(sets[i]) - 1)
            shared = int((sets[i][at] == sets[j]).sum())
            if shared * (num + den) >= num * int(sizes[i] + sizes[j]):
                links.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
                open_ = open_[label[open_] != label[i]]
            else:
                open_ = open_[1:]
    return links


def compare_sketches(
    nodes: list[int], sizes: list[int], sketches: list[bytes], labels: list[int], num: int, den: int
) -> list[tuple[int, int]]:
    """Pairs of a tile that may be linked by their sketches: a forest that connects all of them."""
    order = sorted(range(len(nodes)), key=lambda i: sizes[i])
    nodes, sketches = [nodes[i] for i in order], [sketches[i] for i in order]
    numbers: dict[int, int] = {}
    label = np.array([numbers.setdefault(labels[i], len(numbers)) for i in order])
    sizes = np.array([sizes[i] for i in order], dtype=np.int64)
    lows = np.searchsorted(sizes, -(-num * sizes // den))
    bits = np.array([8 * len(s) for s in sketches], dtype=np.int64)[lows]  # of the least partner
    links = []
    for width in np.unique(bits).tolist():
        mine = np.flatnonzero(bits == width)
        start = int(lows[mine[0]])
        maps = np.stack([folded(s, width) for s in sketches[start : mine[-1] + 1]])
        for i in mine.tolist():
            low = int(lows[i])
            open_ = np.flatnonzero(label[low:i] != label[i]) + low
            if not len(open_):
                continue
            apart = np.bitwise_count(maps[open_ - start] ^ maps[i - start]).sum(axis=1, dtype=np.int64)
            both = sizes[open_] + sizes[i]
            bound = np.minimum((both - apart) // 2, sizes[open_])
            open_ = open_[bound * (num + den) >= num * both]
            others, at = np.unique(label[open_], return_index=True)
            links += [(nodes[i], nodes[j]) for j in open_[at].tolist()]
            label[np.isin(label, others)] = label[i]
    return links


def _compare_tiles(
    rows: DataFrame, tile: list[str], num: int, den: int, size: int | None = None
) -> DataFrame:
    """Links within each tile of (tile columns, node, label, n_shingles, text); of sketches in
    the place of texts, as far as they tell, if there is no size of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, texts, nodes, labels, sizes = None, [], [], [], []

        def links() -> pa.RecordBatch:
            if size is None:
                found = compare_sketches(nodes, sizes, texts, labels, num, den)
            else:
                sets = shingle_sets(texts, size)
                mine = [i for i in range(len(sets)) if node_of(sets[i]) == nodes[i]]
                found = compare(
                    [nodes[i] for i in mine], [sets[i] for i in mine], [labels[i] for i in mine], num, den
                )
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

        for part in slices(batches):
            data = as_bytes(part)
            keys = zip(*(part.column(c).to_pylist() for c in tile))
            columns = (part.column(c).to_pylist() for c in ("node", "label", "n_shingles"))
            for key, node, label, n_shingles, text in zip(keys, *columns, data):
                if key != current:
                    if len(nodes) > 1:
                        yield links()
                    current, texts, nodes, labels, sizes = key, [], [], [], []
                texts.append(text)
                nodes.append(node)
                labels.append(label)
                sizes.append(n_shingles)
        if len(nodes) > 1:
            yield links()

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.select(*tile, "node", "label", "n_shingles", "text")
        .repartition(tasks, *tile)
        .sortWithinPartitions(*tile)
        .mapInArrow(run, "a long, b long")
    )


def _labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the component that the links so far give their node."""
    return rows.join(known.withColumnRenamed("component", "found"), "node", "left").withColumn(
        "label", F.coalesce("found", "node")
    ).drop("found")


def _cross_tiles(rows: DataFrame, tile_shingles: int, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """Tiles that bring each smaller component of a class together with the whole class; and the
    table of blocks that they read."""
    labels = rows.groupBy("class", "label").agg(F.count("*").alias("n"))
    main = labels.groupBy("class").agg(
        F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels")
    ).where("labels > 1").select("class", F.col("main.label").alias("main"))
    sizes = rows.groupBy("class", "label").agg(F.sum("n_shingles").alias("shingles"), F.count("*").alias("n"))
    blocks = (
        sizes.join(main, "class").groupBy("class", "main")
        .agg(F.sum("n").alias("n"), F.sum(F.expr("IF(label <> main, shingles, 0)")).alias("shingles"),
             F.sum(F.expr("IF(label <> main, n, 0)")).alias("minors"))
        .select("class", "main", "n", F.greatest(
            F.ceil(F.col("shingles") / tile_shingles), F.ceil(F.col("minors") / tile_rows)
        ).cast("int").alias("blocks"))
    )
    blocks = written(blocks, "class-blocks")
    rows = join_split_hot(rows, blocks, "class", "n").where("main IS NOT NULL")
    rows = rows.withColumn("minor", F.expr("label <> main"))
    block = "CAST(pmod(xxhash64(node, 3), blocks) AS INT)"
    own = "CAST(pmod(xxhash64(node, 1), tiles) AS INT)"
    keep = ["class", "x", "y", "node", "label", "n_shingles", "text"]
    mains = rows.where("NOT minor").withColumn("x", F.expr(own)).withColumn(
        "y", F.explode(F.expr("sequence(0, blocks - 1)"))
    )
    minors = rows.where("minor").withColumn("y", F.expr(block)).withColumn(
        "x", F.explode(F.expr("sequence(0, tiles - 1)"))
    )
    pairs = (
        rows.where("minor AND blocks > 1").withColumn("own", F.expr(block))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .where("own <> other")
        .withColumn("x", F.expr("-1 - least(own, other)"))
        .withColumn("y", F.expr("greatest(own, other)"))
    )
    return mains.select(*keep).union(minors.select(*keep)).union(pairs.select(*keep)), blocks


def _linked(rows: DataFrame, tile_shingles: int, tile_rows: int, *options) -> DataFrame:
    """node, component: what is linked in each class of (class, tiles, node, n_shingles, text)."""
    first = rows.withColumn("tile", F.expr("CAST(pmod(xxhash64(node, 1), tiles) AS INT)"))
    links = written(
        _compare_tiles(first.withColumn("label", F.col("node")), ["class", "tile"], *options), "links"
    )
    wide = rows.where("tiles > 1")
    if not wide.isEmpty():
        known = components(links)
        again = _labelled(wide, known).withColumn(
            "tile", F.expr("CAST(pmod(xxhash64(node, 2), tiles) AS INT)")
        )
        tables = [links, written(_compare_tiles(again, ["class", "tile"], *options), "links")]
        dropped(known)
        links = reduce(DataFrame.union, tables)
        known = components(links)
        labelled = written(_labelled(wide, known), "labelled")
        rest, blocks = _cross_tiles(labelled, tile_shingles, tile_rows)
        tables.append(written(_compare_tiles(rest, ["class", "x", "y"], *options), "links"))
        dropped(known, labelled, blocks)
        links = reduce(DataFrame.union, tables)
    else:
        tables = [links]
    found = components(links)
    dropped(*tables)
    return found


def _tiled(members: DataFrame, tile_shingles: int, tile_rows: int) -> DataFrame:
    """Members, a table from `written`, with the number of tiles of their class."""
    tiles = members.groupBy("class").agg(
        F.greatest(
            F.ceil(F.sum("n_shingles") / tile_shingles), F.ceil(F.count("*") / tile_rows)
        ).cast("int").alias("tiles"),
        F.count("*").alias("n"),
    )
    tiles = written(tiles, "class-tiles")
    tiled = written(join_split_hot(members, tiles, "class", "n"), "tile-members")
    dropped(tiles)
    return tiled


def _cut_by_sketches(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Members (of classes) with finer classes, written; those whose sketch is like no other are
    left out."""
    members = _tiled(members.drop("tiles"), SKETCH_SHINGLES, SKETCH_ROWS)
    sketches = sets.select("doc_id", "node", F.col("sketch").alias("text")).join(
        broadcast_if_small(members, MEMBERS_BROADCAST), ["doc_id", "node"]
    )
    sketches = written(sketches.select("class", "tiles", "node", "n_shingles", "text"), "sketches")
    finer = _linked(sketches, SKETCH_SHINGLES, SKETCH_ROWS, num, den)
    dropped(sketches)
    found = members.drop("class", "tiles").join(finer.withColumnRenamed("component", "class"), "node")
    found = written(found, "class-members")
    dropped(members, finer)
    return found


def shingle_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    num: int = 90,
    den: int = 100,
    tile_shingles: int = TILE_SHINGLES,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, node, component_id (the least id of the document's component)."""
    with shuffles_go(docs.sparkSession):
        found, _ = _classes(id_text(docs, id_col, text_col), size, num, den, tile_shingles, tile_rows)
    return found


def _classes(
    docs: DataFrame, size: int, num: int, den: int, tile_shingles: int, tile_rows: int
) -> tuple[DataFrame, list[DataFrame]]:
    """What `shingle_classes` returns, and the tables that it reads; others are dropped."""
    frequent = frequent_shingles(docs, size)
    every = written(_sets(docs, size, num, den, frequent), "shingle-sets")  # keys take most of it
    keyed = _shared_keys(every)
    sets = written(every.drop("keys"), "shingle-sketches")
    dropped(every)
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    shared = written(shared.where("least < most").select("key", "least"), "least-nodes")
    ties = keyed.join(shared, "key").where("node <> least").selectExpr("node AS a", "least AS b")
    classes = components(ties)
    dropped(keyed, shared)
    nodes = sets.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles")
    )
    untiled = written(nodes.join(classes.withColumnRenamed("component", "class"), "node"), "class-members")
    members = _tiled(untiled, tile_shingles, tile_rows)
    dropped(classes, untiled)
    wide = members.where("tiles > 1")
    if not wide.isEmpty():
        wide = written(wide, "wide-members")
        cut = _cut_by_sketches(wide, sets, num, den)
        finer = _tiled(cut, tile_shingles, tile_rows)
        narrow, members = members, written(members.where("tiles = 1").unionByName(finer), "tile-members")
        dropped(wide, cut, finer, narrow)
    texts = written(
        docs.join(broadcast_if_small(members, MEMBERS_BROADCAST), "doc_id")
        .select("class", "tiles", "node", "n_shingles", "text"),
        "tile-texts",
    )
    linked = _linked(texts, tile_shingles, tile_rows, num, den, size)
    dropped(texts, members)
    found = nodes.join(linked, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), "doc_id"
    )
    found = written(found, "node-components")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(found.join(least, "component").select("node", "component_id"), "named-nodes")
    dropped(linked, found)
    sketched, sets = sets, written(sets.drop("sketch"), "shingle-counts")
    dropped(sketched)
    full = sets.where("n_shingles > 0").select("doc_id", "n_shingles", "node").join(named, "node", "left")
    full = full.select(
        "doc_id", "n_shingles", "node",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
    blank = sets.where("n_shingles = 0").select(
        "doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id")
    )
    return full.union(blank), [sets, named]


def one_of_each_class(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90,
    den: int = 100, tile_shingles: int = TILE_SHINGLES, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The documents whose id is the least of their class, and those without an id, with all
    columns. Of documents that share an id none goes unless all are copies of others."""
    with shuffles_go(docs.sparkSession):
        found, tables = _classes(id_text(docs, id_col, text_col), size, num, den, tile_shingles, tile_rows)
        gone = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min(F.expr("doc_id <> component_id")).alias("all_copies")
        )
        gone = written(gone.where("all_copies").select(F.col("doc_id").alias("__gone")), "gone")
        dropped(*tables)
    return docs.join(
        broadcast_if_small(gone, MEMBERS_BROADCAST),
        F.col(f"`{id_col}`").cast("long") == F.col("__gone"), "left_anti",
    )
