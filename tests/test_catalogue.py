"""Snapshots, tombstones and damaged files as rows."""

from __future__ import annotations

import json

import numpy as np

from rasterloom.sources import catalogue as C
from rasterloom.sources import dds, images


def names(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_versions_merge_in_any_order(spark, tmp_path):
    root = f"file:{tmp_path}/assets"
    dds.save_files(spark.createDataFrame([("a.txt", bytearray(b"one")), ("sub/b.txt", bytearray(b"two")), ("c.txt", bytearray(b"three"))], "path string, content binary"), root)
    first = spark.createDataFrame(C.snapshot(spark, root, 1).collect(), C.SNAPSHOT)
    assert names(first, "name", "size") == [("a.txt", 3), ("c.txt", 5), ("sub/b.txt", 3)]
    dds.save_files(spark.createDataFrame([("a.txt", bytearray(b"other"))], "path string, content binary"), root)
    second = spark.createDataFrame(C.snapshot(spark, root, 2).filter("name = 'a.txt'").collect(), C.SNAPSHOT)
    gone = C.tombstones(spark.createDataFrame([("c.txt",), ("a.txt",)], "name string"), 2)
    for order in ((first, second, gone), (gone, second, first), (second, gone, first)):
        merged = C.merge(*order)
        assert names(merged, "name", "version", "size", "deleted") == [("a.txt", 2, 5, False), ("c.txt", 2, 0, True), ("sub/b.txt", 1, 3, False)]
    history = first.unionByName(second).unionByName(gone)
    assert names(C.as_of(history, 1), "name") == [("a.txt",), ("c.txt",), ("sub/b.txt",)]
    assert names(C.as_of(history, 2), "name") == [("a.txt",), ("sub/b.txt",)]
    assert names(C.changes(C.as_of(history, 1), C.as_of(history, 2)), "name", "change") == [("a.txt", "changed"), ("c.txt", "removed")]
    assert C.merge(first.limit(0)).count() == 0


def test_damaged_files_are_rows(spark, tmp_path):
    good = dds.pack(8, 4, 61, [bytes(32)])
    decoder = {"C0": 1, "C1": 1, "nin": 3, "nout": 3, "layers": [{"rows": 3, "cols": 3, "weights": [1] * 9, "bias": [0] * 3}]}
    texture = {"file": "a.dds", "mip_count": 1, "mip_sizes": [[8, 4]], "dxgi_format_id": 61, "dxgi_format": "R8"}
    fine = {"format": "x", "decode": {"width": 8, "height": 4, "textures_out": 1}, "textures": [texture, texture], "decoder": decoder}
    files = {
        "ok.dds": good,
        "cut.dds": good[:-1],
        "noise.dds": b"noise" * 40,
        "empty.dds": b"",
        "p.png": images.encode_png(np.zeros((3, 5, 3), np.uint8)),
        "q.png": b"not one",
        "notes.txt": b"text",
        "deep/fine.json": json.dumps(fine).encode(),
        "deep/odd.json": json.dumps(fine | {"decoder": decoder | {"nin": 4}}).encode(),
        "broken.json": b'{"format": ',
    }
    root = f"file:{tmp_path}/all"
    dds.save_files(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary"), root)
    live = C.merge(C.snapshot(spark, root, 1))
    listed = C.listing(live, C.examine(spark, root, live))
    rows = {r["name"]: r for r in listed.collect()}
    assert set(rows) == set(files) - {"empty.dds"}
    assert {n for n, r in rows.items() if r["state"] == "ok"} == {"ok.dds", "p.png", "notes.txt", "deep/fine.json"}
    assert (rows["ok.dds"]["width"], rows["ok.dds"]["height"], rows["ok.dds"]["levels"]) == (8, 4, 1) and (rows["p.png"]["width"], rows["p.png"]["height"]) == (5, 3)
    bad = dict(names(C.quarantine(listed), "name", "reason"))
    assert bad["cut.dds"].startswith("length is") and "nin" in bad["deep/odd.json"] and bad["broken.json"] == "not a descriptor"
    lost = C.examine(spark, root, spark.createDataFrame([("no.dds", 5), ("empty.dds", 0)], "name string, size long"))
    assert names(lost, "name", "reason") == [("empty.dds", "the file is empty"), ("no.dds", "FileNotFoundError")]
