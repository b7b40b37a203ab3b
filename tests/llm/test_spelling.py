from __future__ import annotations

import random
import zlib
from collections import Counter
from itertools import combinations

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwarden.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def want(counts):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]]))
    return sorted(out)


def got(spark, counts, **kw):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.variants(words, **kw).collect())


@settings(deadline=None, max_examples=200)
@given(st.sets(st.text("abé", min_size=1, max_size=6), min_size=2, max_size=25))
def test_composition(words):
    for size in {len(w) for w in words}:
        part = [w for w in words if size - 1 <= len(w) <= size]
        found = []
        for low, high in ((0, size // 2), (size // 2, size)):
            alike = {}
            for w in part:
                alike.setdefault((w[:low], w[len(w) - (size - high) :]), []).append(w)
            for group in alike.values():
                found += [frozenset(p) for p in spelling.near_pairs(group, size, low, high)]
        true = {frozenset(p) for p in combinations(part, 2) if one_edit(*p) and max(map(len, p)) == size}
        assert len(found) == len(set(found)) and set(found) == true


def test_minimised():
    made = spelling.Acceptors()
    made.add(sorted(a + b for a in "abc" for b in ("xing", "xed", "y")))
    assert len(made.arcs) == 7  # the start, after a-c, after x, after xi, xin and xe, the end


def vocabulary(seed, size):
    draw = random.Random(seed)
    base = ["".join(draw.choices("abcé", k=draw.randint(5, 9))) for _ in range(size)]
    words = [w[:i] + w[i + 1 :] for w in base for i in [draw.randrange(len(w))] if len(w) > 5]
    return {w: draw.choice([3, 4, 6, 8, 12, 50]) for w in {*base, *words}}


def test_against_all_pairs(spark):
    counts = vocabulary(1, 600)
    long = "x" * 100
    counts |= {long: 9, long + "x": 3, "y" + long: 4, long[:50] + "z" + long[50:]: 20, long[:49] + "z" + long[50:]: 40}
    assert got(spark, counts) == want(counts)


def test_large_parts_are_cut(spark):
    counts = vocabulary(2, 300) | {"prefix" + w: n for w, n in vocabulary(3, 200).items()}
    counts |= {"abcd" + c: 3 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    assert got(spark, counts, least_part=3) == want(counts)


ROWS = [
    (1, "Hello, hello HELLO wörld WÖRLD Éclair éclair straße", 0), (2, None, 0), (3, "", 0), (None, "hello hallo", 0),
    (4, "hallo wor1d x" * 400, 0), (5, "helo " * 900 + "hellp " * 3, 0), (5, "helo " * 900 + "hellp " * 3, 0),
    (6, "Q" * 30_000 + " " + "q" * 29_999, 0), (7, "q" * 30_000, 0), (8, "q" * 30_000, 0), *[(i, "wörld × ÷÷÷÷÷ hello", 0) for i in range(9, 400)],
]


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, word int").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc_id, text, _ in ROWS:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    rows = queries.op12_spelling(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == want(kept) and len(kept) > 4


def test_no_words(spark):
    assert got(spark, {}) == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.vocabulary(spelling.runs(docs, "[a-z]+"), 5, 3).collect() == []
