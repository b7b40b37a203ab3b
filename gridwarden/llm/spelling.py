"""Spelling variants: words one edit apart, found by composing acceptors with an edit transducer.

The composition vocabulary o one-edit transducer o vocabulary accepts a pair of words that agree
before and after one place. It is cut into parts by initial state: a pair whose longer word has
`size` code points and whose words first differ within places [low, high) of it has read the same
`low` code points before and will read the same `size - high` after, so it lies in the part of
that head and tail. Every word enters four parts, those of the halves of its own length and of the
length above. A part with more than its share of all words is cut again at half its window until
none is left; a window of one place holds words that differ in that place alone, at most one for
each letter. So no task meets a group that grows with the vocabulary, and nothing is dropped.

Within a part a task builds minimised acceptors of the longer and the shorter words' windows, in
one register, and composes: both sides run through equal states until the edit, which replaces or
deletes one code point at the first place where the words differ, and then through pairs of
states whose common language is listed once and shared by all paths that lead there. Windows of
more than `WINDOW` code points are halved inside the task first, so runs of any length do. A task
returns one row a word and part, the number of its near words and the best of them, no pairs.

Defined results: null text has no words. An empty table, or one without frequent words, gives an
empty result. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwarden.session import spread, written

WINDOW = 16  # code points
LEAST_PART = 4_096  # words; parts up to this size are never cut
PARTS = 20_000  # a larger part holds one in so many of all rows, so no more are larger
NEAR_SCHEMA = "word string, n_near long, best_n long, best string"
ARROW_SCHEMA = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def runs(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as text, null: empty) and word of every match, A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(pattern), F.lit(0))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(found).alias("word"),
    ).withColumn("word", F.translate("word", upper, upper.lower()))


def vocabulary(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """word and its number n, for words of enough code points and occurrences."""
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


class Acceptors:
    """Minimised acyclic acceptors in one register: states of equal right language are one state."""

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._common: dict[tuple[int, int], list[str]] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.arcs)
            self.arcs.append(dict(arcs))
            self.final.append(final)
        return state

    def add(self, words: list[str], at: int = 0) -> int:
        """The initial state of the acceptor of sorted, distinct words that agree before `at`."""
        final = len(words[0]) == at
        rest = words[1:] if final else words
        if len(rest) == 1:
            state = self._state(True, [])
            for c in reversed(rest[0][at + final :]):
                state = self._state(False, [(c, state)])
            return self._state(True, [(rest[0][at], state)]) if final else state
        arcs = [(c, self.add(list(part), at + 1)) for c, part in groupby(rest, key=lambda w: w[at])]
        return self._state(final, arcs)

    def common(self, p: int, q: int) -> list[str]:
        """The strings that both states accept."""
        key = (p, q) if p < q else (q, p)
        found = self._common.get(key)
        if found is None:
            found = [""] if self.final[p] and self.final[q] else []
            one, two = self.arcs[p], self.arcs[q]
            for c in one if p == q else one.keys() & two.keys():
                found += [c + s for s in self.common(one[c], two[c])]
            self._common[key] = found
        return found


def compose(longer: list[str], shorter: list[str]) -> list[tuple[str, str]]:
    """Pairs one edit apart: two of `longer` with one code point replaced, or one of `longer`
    with one of `shorter` that lacks a code point. Lists are sorted and distinct, words of
    `longer` have one length, those of `shorter` one less."""
    made = Acceptors()
    memo: dict[tuple, list[tuple[str, str]]] = {}

    def pairs(p: int, q: int | None) -> list[tuple[str, str]]:
        found = memo.get((p, q))
        if found is None:
            found, arcs = [], made.arcs[p]
            for (a, left), (b, right) in combinations(arcs.items(), 2):
                found += [(a + s, b + s) for s in made.common(left, right)]
            for a, left in arcs.items():
                if q is not None:
                    found += [(a + s, s) for s in made.common(left, q) if not s.startswith(a)]
                onward = made.arcs[q].get(a) if q is not None else None
                found += [(a + u, a + v) for u, v in pairs(left, onward)]
            memo[p, q] = found
        return found

    return pairs(made.add(longer), made.add(shorter) if shorter else None)


def near_pairs(words: list[str], size: int, low: int, high: int) -> Iterator[tuple[str, str]]:
    """Pairs of one part, words of `size` or `size - 1` code points that agree outside the window."""
    longer = sum(len(w) == size for w in words)
    if longer == 0 or len(words) < 2:
        return
    if high - low > WINDOW:
        middle = (low + high) // 2
        for start, stop in ((low, middle), (middle, high)):
            parts = defaultdict(list)
            for w in words:
                parts[w[low:middle] if start == middle else w[len(w) - (size - middle) : len(w) - (size - high)]].append(w)
            for part in parts.values():
                yield from near_pairs(part, size, start, stop)
        return
    cut = {w[low : len(w) - (size - high)]: w for w in words if len(w) == size}
    cut_less = {w[low : len(w) - (size - high)]: w for w in words if len(w) < size}
    for u, v in compose(sorted(cut), sorted(cut_less)):
        if len(u) == len(v):
            yield cut[u], cut[v]
        elif u[:-1] != v or high == size or cut[u][high] != u[-1]:  # else they first differ later
            yield cut[u], cut_less[v]


def _near_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; parts of equal keys are told apart by what they share."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = rows.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield from _near_in_table(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield from _near_in_table(held)


def _near_in_table(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    keys = rows.column("key").to_numpy()
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(starts, append=len(keys))
    several = np.repeat(sizes > 1, sizes)
    if not several.any():
        return
    rows = rows.filter(pa.array(several))
    columns = [rows.column(c).to_pylist() for c in ("size", "low", "high", "word", "n")]
    out = [[], [], [], []]
    ends = np.cumsum(sizes[sizes > 1]).tolist()
    for start, end in zip([0, *ends], ends):
        parts, count = defaultdict(list), {}
        for size, low, high, word, n in zip(*(c[start:end] for c in columns)):
            parts[size, low, high, word[:low], word[len(word) - (size - high) :]].append(word)
            count[word] = n
        for (size, low, high, *_), words in parts.items():
            near = defaultdict(list)
            for u, v in near_pairs(words, size, low, high):
                near[u].append(v)
                near[v].append(u)
            for word, others in near.items():
                best = min(others, key=lambda w: (-count[w], w))
                for column, value in zip(out, (word, len(others), count[best], best)):
                    column.append(value)
        if len(out[0]) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ARROW_SCHEMA)], schema=ARROW_SCHEMA)
            out = [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ARROW_SCHEMA)], schema=ARROW_SCHEMA)


def _key() -> Column:
    """What the words of one part share; equal hashes of different parts do no harm."""
    shared = F.expr("substring(word, length(word) - (size - high) + 1, size - high)")
    return F.xxhash64("size", "low", "high", F.expr("substring(word, 1, low)"), shared)


def _halved(rows: DataFrame) -> DataFrame:
    """Every row twice, with the halves of its window; rows of one place stay as they are."""
    windows = F.expr(
        "IF(high - low > 1, array(struct(low, (low + high) DIV 2 AS high), "
        "struct((low + high) DIV 2 AS low, high)), array(struct(low, high)))"
    )
    cut = rows.select("word", "n", "size", F.explode(windows).alias("w"))
    cut = cut.select("word", "n", "size", F.col("w.low").cast("int").alias("low"), F.col("w.high").cast("int").alias("high"))
    return cut.withColumn("key", _key())


def _parts(words: DataFrame, least_part: int) -> DataFrame:
    """key, size, low, high, word, n: the parts that each word enters, none above its share."""
    whole = words.select(
        "word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"), F.lit(0).alias("low")
    ).withColumn("high", F.col("size"))
    rows = _halved(whole)
    done = None
    while True:
        rows = written(rows, "spelling-parts")
        sizes = written(rows.groupBy("key", "low", "high").agg(F.count("*").alias("rows")), "spelling-sizes")
        share = max(least_part, (sizes.agg(F.sum("rows")).first()[0] or 0) // PARTS)
        large = sizes.where((F.col("rows") > share) & (F.col("high") - F.col("low") > 1)).select("key")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fine = rows.join(F.broadcast(large), "key", "left_anti").select(*rows.columns)
        done = fine if done is None else done.unionByName(fine)
        rows = _halved(rows.join(F.broadcast(large), "key", "left_semi"))


def near_words(words: DataFrame, least_part: int = LEAST_PART) -> DataFrame:
    """word, n_near, best_n, best: for words with others one edit apart, their number and the
    most frequent of them (ties: the first in code-point order). `words` has distinct words."""
    rows = spread(_parts(words.select("word", F.col("n").cast("long").alias("n")), least_part), "key")
    found = rows.sortWithinPartitions("key").mapInArrow(_near_in_parts, NEAR_SCHEMA)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: the last of the forms. Counts at least double from form to form, so that
    few steps end every chain, and each step doubles the length that is followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(
            now.join(onward, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(words: DataFrame, least_part: int = LEAST_PART) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts n.

    The form of a word is its most frequent near word if that occurs at least twice as often."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    joined = words.join(near_words(words, least_part), "word", "left")
    has_form = F.col("best_n") >= 2 * F.col("n")
    facts = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(facts.where("form IS NOT NULL"))
    return facts.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
