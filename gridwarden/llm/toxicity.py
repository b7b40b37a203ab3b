"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

Restoring. A character trigram model is counted over the words of the labelled rows. A token
that is no plain word (digits or signs among its letters or at its ends, the same letter twice in
a row in a word that clean labelled rows do not know, or letters spelled out one by one with
anything between them) becomes a lattice: each character may stand for itself, for letters that
it resembles, for nothing (repetition, filler), or for a word boundary, at a fixed channel cost.
Viterbi decoding finds the cheapest path under channel and character model. The letters as they
stand count as well. Plain words are the lattice with a single path and need no decoding.

Scoring. Features of a word are the whole word and its first 4 to 8 letters. A feature weighs
the lower Wilson bound (z = 2.5) of its share of toxic rows, as log odds against the share of all
rows; it is evidence from a weight of `LEAST` on, unless a longer first part has nearly all of
its toxic rows. A word counts with its shortest evidence, a text with the sum over its distinct
words, and a logistic curve fitted to the labelled rows turns the sum into the score. So that a
copied text does not vouch for all of its words, labelled rows that share their least shingle
hash count once, and no feature counts for more rows than it has different neighbours.

The model is fitted on all labelled rows. Rows and features are counted, joined and weighed as
tables; what travels to all tasks is the model: the words that are evidence, the known words with
doubled letters, and, as long as there are at most `WANTED`, the features of toxic rows, which save
the shuffle of all features of clean rows. Scoring covers all rows and whole texts.

Defined results: null and empty texts have no words and get the score of a text without
evidence; label rows with null id or label, or without a document, are not used; ids labelled
twice are used with each label; without labelled rows every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.llm.common import as_texts, id_text, slices
from gridwarden.session import broadcast_if_small, dropped, written

Z = 2.5
MIN_TOXIC = 5
LEAST = 1.2
PREFIXES = range(4, 9)
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
EDGE = len(LETTERS)
WIDTH = EDGE + 1
CODE = {c: i for i, c in enumerate(LETTERS)}
CODE_OF_BYTE = np.full(256, EDGE, np.int64)  # the alphabet is within Latin-1
CODE_OF_BYTE[[ord(c) for c in LETTERS]] = range(EDGE)
# Letters that a sign or digit resembles.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
LOOKS, FILLER, DIGIT_FILLER, REPEAT, BREAK = 1.0, 4.0, 8.0, 0.5, 2.0  # channel costs
SIGNS = "".join(re.escape(c) for c in LOOKS_LIKE if not c.isdigit())
# Single letters, digits or look-alike signs with anything else between them.
SPELLED = re.compile(
    rf"(?<![^\W_])(?:[^\W_]|[{SIGNS}])(?:(?:[^\w{SIGNS}]|_)+(?:[^\W_]|[{SIGNS}])){{2,}}(?![^\W_])"
)
INNER = re.compile(r"[^\W\d_]")
DOUBLE = re.compile(r"([^\W\d_])\1")
PAIRS_AT_MOST = re.compile(rf"(?:([{LETTERS}])(?!\1\1))+")
IN_ALPHABET = re.compile(rf"[{LETTERS}]+")
BROADCAST_ROWS = 1_000_000  # labelled ids that may be broadcast
WANTED = 500_000  # features of toxic rows that may travel to the clean ones
HELD = 500_000  # features that a task counts before it passes the counts on
KNOWN_ROWS = 3  # clean labelled rows that make a word known


def letter_costs(counts: dict[int, int]) -> list[float]:
    """-log P(c | a, b) at (a * WIDTH + b) * WIDTH + c, trigrams backed by bigrams."""
    pairs, heads = Counter(), Counter()
    bigrams, singles = Counter(), Counter()
    for code, n in counts.items():
        context, last = divmod(code, WIDTH)
        pairs[code] += n
        heads[context] += n
        bigrams[context % WIDTH, last] += n
        singles[context % WIDTH] += n
    costs = []
    for a in range(WIDTH):
        for b in range(WIDTH):
            head = heads[a * WIDTH + b]
            for c in range(WIDTH):
                back = (bigrams[b, c] + 0.1) / (singles[b] + 0.1 * WIDTH)
                share = (pairs[(a * WIDTH + b) * WIDTH + c] + 5 * back) / (head + 5)
                costs.append(-math.log(share))
    return costs


def trigram_codes(word: str) -> list[int]:
    """Trigrams of a word with its edges; none if a character is outside the alphabet."""
    try:
        codes = [EDGE, EDGE, *(CODE[c] for c in word), EDGE]
    except KeyError:
        return []
    return [
        (codes[i] * WIDTH + codes[i + 1]) * WIDTH + codes[i + 2] for i in range(len(codes) - 2)
    ]


def trigram_counts(words: dict[str, int]) -> dict[int, int]:
    """Trigrams of words with their edges; none of a word with a character outside the alphabet."""
    known = [w for w in words if IN_ALPHABET.fullmatch(w)]
    sizes = np.fromiter(map(len, known), np.int64, len(known)) + 3
    symbols = np.frombuffer("".join(f"  {w} " for w in known).encode("latin-1"), np.uint8)
    codes = CODE_OF_BYTE[symbols]
    nth = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(nth < np.repeat(sizes - 2, sizes))
    trigrams = (codes[at] * WIDTH + codes[at + 1]) * WIDTH + codes[at + 2]
    times = np.repeat(np.fromiter((words[w] for w in known), np.int64, len(known)), sizes - 2)
    found, place = np.unique(trigrams, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, place, times)
    return dict(zip(found.tolist(), sums.tolist()))


def _decode_letters(observed: str, costs: list[float]) -> list[str]:
    """`decode` of letters of the alphabet, none three times in a row: the two paths that a pair of
    equal letters opens meet again after the next letter, so one comparison settles the pair."""
    a = b = EDGE
    cost, last, kept, drop = 0.0, "", [], None  # drop: cost and letter before, if the pair is one letter
    for char in (*observed, ""):
        code = CODE[char] if char else EDGE
        longer = cost + costs[(a * WIDTH + b) * WIDTH + code]
        if drop:
            shorter = drop[0] + costs[(drop[1] * WIDTH + b) * WIDTH + code]
            if shorter < longer:
                kept.pop()
                longer = shorter
        drop = (cost + REPEAT, a) if char == last else None
        cost, a, b, last = longer, b, code, char
        kept.append(char)
    return ["".join(kept)]


def decode(observed: str, costs: list[float]) -> list[str]:
    """Viterbi: the words of the cheapest path through the lattice of an observed token."""
    if PAIRS_AT_MOST.fullmatch(observed):
        return _decode_letters(observed, costs)
    beam: dict[int, tuple[float, tuple]] = {EDGE * WIDTH + EDGE: (0.0, ())}
    last = ""
    for char in observed:
        choices: list[tuple[int, float]] = []  # emitted symbol or -1, channel cost
        if char in CODE:
            choices.append((CODE[char], 0.0))
            if char == last:
                choices.append((-1, REPEAT))
        elif char in LOOKS_LIKE:
            choices += [(CODE[c], LOOKS) for c in LOOKS_LIKE[char]]
            filler = DIGIT_FILLER if char.isdigit() else FILLER
            choices.append((-1, REPEAT if char == last else filler))
        else:
            choices += [(-1, 0.0), (EDGE, BREAK)]
        if char in CODE or char in LOOKS_LIKE:
            last = char  # a repetition may have separators between
        following: dict[int, tuple[float, tuple]] = {}
        for state, (cost, path) in beam.items():
            for symbol, channel in choices:
                if symbol < 0:
                    total, target, new = cost + channel, state, path
                elif symbol == EDGE:
                    if state % WIDTH == EDGE:
                        continue  # no empty words
                    total = cost + channel + costs[state * WIDTH + EDGE]
                    target, new = EDGE * WIDTH + EDGE, (path, EDGE)
                else:
                    total = cost + channel + costs[state * WIDTH + symbol]
                    target, new = state % WIDTH * WIDTH + symbol, (path, symbol)
                best = following.get(target)
                if best is None or total < best[0]:
                    following[target] = (total, new)
        if following:
            beam = following
    ends = ((cost + costs[state * WIDTH + EDGE], path) for state, (cost, path) in beam.items())
    path, letters = min(ends, key=lambda e: e[0])[1], []
    while path:
        path, symbol = path
        letters.append(" " if symbol == EDGE else LETTERS[symbol])
    return "".join(reversed(letters)).split()


@dataclass
class Model:
    costs: list[float] = field(default_factory=list)
    evidence: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -math.inf  # score 0 as long as nothing is learnt
    known: frozenset[str] = frozenset()  # clean words with doubled letters

    def weight(self, word: str) -> float:
        """Of the shortest evidence in the word; 0 without any."""
        for size in PREFIXES:
            if len(word) < size:
                break
            found = self.evidence.get(word[:size])
            if found is not None:
                return found
        return self.evidence.get(word + " ", 0.0)

    def score(self, total: float) -> float:
        x = self.offset + self.slope * total
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


class Lookup:
    """What the distinct tokens of a text give: the union of `give(token)`. Tokens that give
    nothing, nearly all, are taken out by one set difference; up to `limit` tokens are kept."""

    def __init__(self, give: Callable[[str], tuple], limit: int = 500_000):
        self.give, self.limit = give, limit
        self.plain: set[str] = set()
        self.hits: dict[str, tuple] = {}

    def of(self, tokens: set[str]) -> set:
        if len(self.plain) + len(self.hits) > self.limit:
            self.plain.clear()
            self.hits.clear()
        out: set = set()
        for token in tokens - self.plain:
            found = self.hits.get(token)
            if found is None:
                found = self.give(token)
                if not found:
                    self.plain.add(token)
                    continue
                self.hits[token] = found
            out.update(found)
        return out


class Restorer:
    """Words of tokens and texts."""

    def __init__(self, costs: list[float], plain: frozenset[str] = frozenset()):
        self.costs, self.plain = costs, plain
        self.decoded: dict[str, list[str]] = {}  # of tokens without the signs around them

    def _decode(self, core: str) -> list[str]:
        found = self.decoded.get(core)
        if found is None:
            if len(self.decoded) >= 200_000:
                self.decoded.clear()
            found = self.decoded[core] = decode(core, self.costs)
        return found

    def token(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and (token in self.plain or not DOUBLE.search(token)):
            return (token,)
        start, end = 0, len(token)
        while end and not token[end - 1].isalnum():
            end -= 1
        while start < end and not token[start].isalnum():
            start += 1
        core = token[start:end]
        words = [core] if core.isalpha() else []
        if not INNER.search(core):
            return tuple(words)
        if not words or (core not in self.plain and DOUBLE.search(core)):
            words += self._decode(core)
        first, last = start, end  # signs next to the letters may be letters
        while first and token[first - 1] in LOOKS_LIKE:
            first -= 1
        while last < len(token) and token[last] in LOOKS_LIKE:
            last += 1
        for i, j in {(first, end), (start, last), (first, last)} - {(start, end)}:
            words += decode(token[i:j], self.costs)
        return tuple(dict.fromkeys(words))

    def spelled(self, text: str) -> set[str]:
        """Words that a text in lower case spells out letter by letter."""
        found: set[str] = set()
        for spelled in {match[0] for match in SPELLED.finditer(text)}:
            if INNER.search(spelled):
                letters = "".join(c for c in spelled if c.isalnum() or c in LOOKS_LIKE)
                if letters.isalpha():
                    found.add(letters)
                found.update(decode(spelled, self.costs))
        return found

    def words(self, text: str) -> set[str]:
        text = text.lower()
        return self.spelled(text).union(*map(self.token, set(text.split())))


def features(words: set[str]) -> set[str]:
    """Whole words, marked by a final space, and their first letters."""
    out = {w + " " for w in words if len(w) > 2}
    for size in PREFIXES:
        out.update([w[:size] for w in words if len(w) >= size])
    return out


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents, one row for each label."""
    rows = written(labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct(), "label-rows")
    return docs.join(broadcast_if_small(rows, BROADCAST_ROWS), "doc_id")


def _tri_counts(lists: Iterable[list[str]], counts: Counter) -> None:
    """Adds the trigrams of the words of some texts."""
    words: Counter = Counter()
    for tokens in lists:
        words.update(set(tokens))
    stripped: Counter = Counter()
    for word, n in words.items():
        stripped[word.strip(".,;:!?\"'()")] += n
    counts.update(trigram_counts(stripped))


def _letters_and_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mark of every row, then the trigrams of all of them."""
    counts: Counter = Counter()
    for part in slices(batches):
        lists = [t.lower().split() for t in as_texts(part)]
        _tri_counts(lists, counts)
        none = pa.nulls(len(lists), pa.int64())
        marks = pa.array(_least_shingles(lists), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("toxic"), marks, none, none], names=MARKS
        )
    none = pa.nulls(len(counts), pa.int64())
    codes, n = pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), none, codes, n], names=MARKS)


MARKS = ["doc_id", "toxic", "mark", "code", "n"]


def _least_shingles(lists: list[list[str]]) -> list[int]:
    """The least hash of three words of each text; equal in most copies of a text."""
    lists = [words or [""] for words in lists]
    codes = {w: xxhash.xxh64_intdigest(w) for w in set().union(*lists)}
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.uint64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(lists), np.uint64)
    for span in (1, 2, 3):  # fewer words than three are one shingle
        mine = np.flatnonzero(sizes >= 3 if span == 3 else sizes == span)
        if not len(mine):
            continue
        mixed = np.zeros(len(h) - span + 1, np.uint64)
        for k in range(span):
            mixed = (mixed ^ h[k : len(h) - span + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        cuts = np.stack([starts[mine], starts[mine] + sizes[mine] - span + 1], axis=1).ravel()
        if cuts[-1] == len(mixed):
            cuts = cuts[:-1]
        out[mine] = np.minimum.reduceat(mixed, cuts)[::2]
    return (out >> np.uint64(1)).tolist()


def _logit(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return math.log(share / (1 - share))


def lower_bound(toxic: int, clean: int) -> float:
    """Lower Wilson bound of the toxic share."""
    every = toxic + clean
    if not every:
        return 0.0
    share = toxic / every
    spread = Z * math.sqrt(share * (1 - share) / every + Z * Z / (4 * every * every))
    return (share + Z * Z / (2 * every) - spread) / (1 + Z * Z / every)


def _weighed(toxic: DataFrame, clean: DataFrame, prior: float) -> DataFrame:
    """(feature, n, clean): features that weigh enough and are not explained. One is explained if
    it is no whole word and a longer first part has nearly all of its rows."""
    last = F.expr("right(feature, 1)")
    longer = toxic.groupBy(F.expr("left(feature, length(feature) - 1)").alias("feature")).agg(
        F.max(F.when(last.isin(*LETTERS), F.col("n"))).alias("longer"),
        F.max(last == " ").alias("word"),
    )
    table = toxic.join(clean, "feature", "left").join(longer, "feature", "left").fillna(0, ["clean", "longer"])
    whole = F.coalesce("word", F.lit(False)) | (last == " ")
    open_ = table.where(whole | (F.col("longer") < 0.9 * F.col("n"))).select("feature", "n", "clean")

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = zip(batch.column("n").to_pylist(), batch.column("clean").to_pylist(), strict=True)
            yield batch.filter(pa.array([_logit(lower_bound(*c)) - prior >= LEAST for c in counts], pa.bool_()))

    return open_.mapInArrow(heavy, open_.schema)


def _curve(counts: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a little shrinkage."""
    slope, offset = 1.0, -3.0
    for _ in range(50):
        g = [0.01 * (slope - 1), 0.01 * (offset + 3)]
        h = [[0.01, 0.0], [0.0, 0.01]]
        for x, toxic, n in counts:
            p = 1 / (1 + math.exp(min(500.0, -slope * x - offset)))
            for i, u in enumerate((x, 1.0)):
                g[i] += n * (p - toxic) * u
                for j, v in enumerate((x, 1.0)):
                    h[i][j] += n * p * (1 - p) * u * v
        det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
        steps = ((h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[1][0] * g[0]) / det)
        slope -= max(-1.0, min(1.0, steps[0]))
        offset -= max(-1.0, min(1.0, steps[1]))
    return max(slope, 0.0), offset


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """A model from documents and 0/1 labels."""
    texts = id_text(docs, id_col, text_col)
    labels = labels.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{label_col}`").cast("int").alias("toxic"),
    )
    labelled = written(_labelled(texts, labels), "labelled")  # read by each step below
    columns = "doc_id long, toxic int, mark long, code long, n long"
    seen = written(labelled.select("doc_id", "toxic", "text").mapInArrow(_letters_and_marks, columns), "marks")
    counts = seen.where("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n"))
    costs = letter_costs({r.code: r.n for r in counts.collect()})  # at most the alphabet's trigrams
    single = seen.where("code IS NULL").groupBy("mark", "toxic").agg(F.min("doc_id").alias("doc_id"))
    single = written(single.select("doc_id", "toxic").distinct(), "labelled-ids")
    sizes = {r.toxic: r["count"] for r in single.groupBy("toxic").count().collect()}
    if not sizes:
        dropped(labelled, seen, single)
        return Model(costs)
    ids = broadcast_if_small(single, BROADCAST_ROWS)
    rows = labelled.join(ids, ["doc_id", "toxic"])
    if ids is single:  # shuffled once, not by each step below
        rows = written(rows, "labelled-once")

    def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(token: str) -> tuple[str, ...]:
            word = token.strip(".,;:!?\"'()")
            return (word,) if word.isalpha() and DOUBLE.search(word) else ()

        lookup, found = Lookup(give), Counter()
        for part in slices(batches):
            for text in as_texts(part):
                found.update(lookup.of(set(text.lower().split())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
            names=["word", "n"],
        )

    clean_words = rows.where("toxic = 0").select("text").mapInArrow(doubled, "word string, n long")
    clean_words = clean_words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= KNOWN_ROWS)
    known = frozenset(r.word for r in clean_words.collect())

    def total(label: int, wanted: set[str] | None) -> DataFrame:
        """(feature, n): rows of each feature, of those wanted if any are named."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer, found = Restorer(costs, known), Counter()

            def mine(words: Iterable[str]) -> set[str]:
                every = features(set(words))
                return every if wanted is None else every & wanted

            def counted() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                    names=["feature", "n"],
                )

            lookup = Lookup(lambda token: tuple(mine(restorer.token(token))))
            for part in slices(batches):
                for text in as_texts(part):
                    text = text.lower()
                    here = lookup.of(set(text.split()))
                    spelled = restorer.spelled(text)
                    found.update(here | mine(spelled) if spelled else here)
                if len(found) > HELD:
                    yield counted()
                    found.clear()
            yield counted()

        found = rows.where(F.col("toxic") == label).select("text").mapInArrow(run, "feature string, n long")
        return found.groupBy("feature").agg(F.sum("n").alias("n"))

    prior = _logit((sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1))
    toxic = written(total(1, None).where(F.col("n") >= MIN_TOXIC), "toxic-features")
    few = toxic.count() <= WANTED
    clean = total(0, {r.feature for r in toxic.select("feature").collect()} if few else None)
    found = _weighed(toxic, clean.withColumnRenamed("n", "clean"), prior).collect()
    strong = {r.feature: (r.n, r.clean) for r in found}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found = Restorer(costs, known), set()
        lookup = Lookup(lambda token: tuple(features(set(restorer.token(token))) & strong.keys()))
        for part in slices(batches):
            for text in as_texts(part):
                tokens = text.lower().split()
                lookup.of(set(tokens))
                for nth, token in enumerate(tokens):
                    for feature in lookup.hits.get(token, ()):
                        found.add((feature, " ".join(tokens[max(0, nth - 1) : nth + 2])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())],
            names=["feature", "context"],
        )

    contexts = (
        rows.where("toxic = 1").select("text").mapInArrow(neighbours, "feature string, context string")
        .groupBy("feature").agg(F.countDistinct("context").alias("n"))
    )
    model = Model(costs, known=known)
    for row in contexts.collect():
        n, beside = strong[row.feature]
        weight = _logit(lower_bound(min(n, row.n), beside)) - prior
        if weight >= LEAST:
            model.evidence[row.feature] = weight
    sums = score(rows, model).select("doc_id", F.round("total", 1).alias("x"))
    counts = sums.join(ids, "doc_id").groupBy("x", "toxic").count().collect()
    model.slope, model.offset = _curve([(r.x, r.toxic, r["count"]) for r in counts])
    dropped(labelled, seen, single, rows, toxic)
    return model


class Scorer:
    """Sums of evidence of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.restorer = Restorer(model.costs, model.known)
        self.heads = {feature[:3] for feature in model.evidence}  # evidence has three letters or more
        self.lookup = Lookup(lambda token: self._evident(self.restorer.token(token)))

    def _evident(self, words: Iterable[str]) -> tuple[str, ...]:
        return tuple(w for w in words if w[:3] in self.heads and self.model.weight(w))

    def weigh(self, text: str) -> tuple[float, list[str]]:
        text = text.lower()
        mine = self.lookup.of(set(text.split())).union(self._evident(self.restorer.spelled(text)))
        mine = sorted(mine)  # so that the sum does not depend on the order of a set
        return sum(map(self.model.weight, mine)), mine


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, score in 0..1, the sum of evidence, and the restored words that are
    evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches):
            found = [scorer.weigh(t) for t in as_texts(part)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([model.score(total) for total, _ in found], pa.float64()),
                    pa.array([total for total, _ in found], pa.float64()),
                    pa.array([words for _, words in found], pa.list_(pa.string())),
                ],
                names=["doc_id", "score", "total", "evidence"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, total double, evidence array<string>"
    )


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score under one half, with all columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches, text=text_col):
            texts = as_texts(pa.RecordBatch.from_arrays([part.column(at)], names=["text"]))
            keep = [model.score(scorer.weigh(t)[0]) < 0.5 for t in texts]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
