from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from gridwarden.llm.chat_format import END, START, rotate
from gridwarden.llm.license_scan import scan
from gridwarden.llm.license_texts import KNOWN

DOCS = "doc_id long, text string, digest string, notices string"
TURNS = "conv_id long, turn long, role string, text string, piece string"
MIT = max((t for n, t in KNOWN if n == "MIT"), key=len)


def test_licenses(spark):
    shouted = "Copyright (c) 1999 Somebody\n\n  " + MIT.upper().replace("LICENSE", "LICENCE").replace(",", " ;")
    rows = [
        (1, MIT, "", ""), (2, shouted, "", ""), (3, "prose\nReleased under the MIT Licence!\nmore", "", ""),
        (4, MIT + " and more", "", ""), (5, None, "", ""), (None, "", "", ""), (6, "© 2020 X\nall rights reserved", "", ""),
        (3, "prose\nReleased under the MIT Licence!\nmore", "", ""), (7, "word " * 100_000, "", ""),
        (8, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "", ""),
    ]
    got = {(r.doc_id, r.whole_license, tuple(r.notices), r.n_notices) for r in scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert {g for g in got if g[0] not in (1, 2)} == {
        (3, None, ("MIT",), 1), (4, None, (), 0), (5, None, (), 0), (None, None, (), 0), (6, None, (), 0),
        (7, None, (), 0), (8, None, ("Apache-2.0", "CC-BY-NC-4.0"), 2),
    }
    assert {g[:2] for g in got if g[0] in (1, 2)} == {(1, "MIT"), (2, "MIT")}
    assert len(scan(spark.createDataFrame(rows, DOCS)).collect()) == len(rows)
    assert scan(spark.createDataFrame([], DOCS)).collect() == []


def test_own_table_of_licenses(spark):
    known = spark.createDataFrame([("House", "Use it   wisely.")], "license string, text string")
    got = scan(spark.createDataFrame([(1, "USE IT, WISELY", "", "")], DOCS), known=known).first()
    assert (got.whole_license, got.notices) == ("House", ["House"])


def test_whole_texts_of_common_licenses(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
             "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows, want = [], {}
    for file, name in files.items():
        text = (folder / file).read_text()
        for form in (text, text.upper(), " ".join(text.split()), text.split("END OF TERMS AND CONDITIONS\n")[0]):
            want[len(rows)] = name
            rows.append((len(rows), form, "", ""))
    got = {r.doc_id: r.whole_license for r in scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


def test_rows_of_one_id_with_other_line_breaks(spark):
    rows = [(1, "Released under the MIT License.\nfoo"), (1, "Released under the MIT License. foo"), (None, "MIT License\nx"), (None, "MIT License x")]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    alone = [scan(spark.createDataFrame([r], "doc_id long, text string")).collect()[0] for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, alone))
    assert len({tuple(r.notices) for r in got}) > 1


def render(turns, perspective):
    text, spans = "", []
    order = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "unknown", t[3] or ""))
    for _, _, role, said, *_ in order:
        said = (said or "").replace("<|im_", "<| im_")
        role = role or "unknown"
        head = "assistant" if role == perspective else "user name=" + "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in role)
        text += f"{START}{head}\n"
        start = len(text)
        text += said + END
        if role == perspective:
            spans.append((start, len(text)))
        text += "\n"
    return text, spans


@pytest.mark.parametrize("chunk", [2, 512])
def test_rotation(spark, chunk):
    rows = [
        (1, 0, "ann", "hi", ""), (1, 1, "bob", "hello <|im_end|>", ""), (1, 2, "ann", None, ""), (1, 3, "Zoë K", "é", ""),
        (2, 5, None, "x", ""), (2, None, "bob", "first", ""), (None, 0, "ann", "a", ""), (None, 1, "bob", "b", ""),
        (3, 0, "ann", "same", ""), (3, 0, "ann", "same", ""), (4, 0, "ann", "long " * 50_000, ""),
        *[(5, None, "ann" if i % 2 else "bob", f"t{i % 4}", "") for i in range(11)],
        *[(6, 7, "ann", f"t{i % 4}", "") for i in range(9)], (6, 8, "bob", "last", ""),
    ]
    got = rotate(spark.createDataFrame(rows, TURNS), chunk=chunk).collect()
    views = {}
    for r in got:
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    wanted = {(c, r or "unknown") for c, _, r, *_ in rows}
    assert set(views) == wanted
    for (conv, who), pieces in views.items():
        pieces.sort(key=lambda r: r.char_start)
        text, spans = render([r for r in rows if r[0] == conv], who)
        assert "".join(p.piece for p in pieces) == text
        assert [p.char_start for p in pieces] == [0, *(p.char_end for p in pieces[:-1])]
        assert [(p.train_start, p.train_end) for p in pieces if p.train_start is not None] == spans
    assert rotate(spark.createDataFrame([], TURNS)).collect() == []


def test_queries_and_their_sql(spark, sf_dir):
    from gridwarden.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, sf_dir)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)), name
