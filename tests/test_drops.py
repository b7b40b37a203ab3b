"""The drops of the feed: four batches, each of files of bounded size."""

from __future__ import annotations

import glob

from gridwarden.plans import catalog
from gridwarden.streaming import ingest


def test_drops_come_in_bounded_files(spark, sf_dir, monkeypatch):
    whole = catalog.validate.report(catalog.raw(spark, sf_dir), catalog.S).first().asDict()
    monkeypatch.setattr(catalog, "ROWS_A_FILE", 50, raising=False)
    sizes = []
    original = ingest.ingest_available

    def taken(spark, drops, *rest, **named):
        sizes.append([len(open(f).readlines()) - 1 for f in glob.glob(f"{drops}/*.csv")])
        return original(spark, drops, *rest, **named)

    monkeypatch.setattr(ingest, "ingest_available", taken)
    got = catalog.QUERIES["ingest_incremental"](spark, sf_dir).first().asDict()
    assert {k: got[k] for k in whole} == whole
    assert [sum(s) for s in sizes] == sorted({sum(s) for s in sizes}) and len(sizes) == 4
    assert sum(sizes[-1]) == whole["total_rows_seen"] and max(sizes[-1]) <= 100
