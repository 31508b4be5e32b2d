from __future__ import annotations

import json
import struct

import numpy as np
import pytest

from rasterloom.functions.config import parse_double, parse_int, parse_list, parse_size
from rasterloom.sources import dds, descriptor, images, material


def test_dds_round_trip_and_refusals(spark, tmp_path):
    levels = [bytes(range(64)) * 2, bytes(range(32))]  # 16 x 16 BC4, then 8 x 8
    data = dds.pack(16, 16, 80, levels)
    assert [x[5] for x in dds.unpack(data, strict=True)] == levels
    for broken in (data[:-1], b"DDX " + data[4:], data[:128] + b"\x00" + data[129:], dds.pack(16, 16, 80, levels[:1])[:100]):
        with pytest.raises(ValueError):
            dds.unpack(broken)
    rows = spark.createDataFrame([("m/a.dds", i, 16 >> i, 16 >> i, 80, 1, bytearray(b)) for i, b in enumerate(levels)], "path string, level int, width int, height int, dxgi int, channels int, bytes binary")
    dds.save_files(dds.write_levels(rows), f"file:{tmp_path}/out")
    assert (tmp_path / "out/m/a.dds").read_bytes() == data
    back = dds.read_levels(spark, str(tmp_path / "out/m"), strict=True).orderBy("level").collect()
    assert [bytes(r["bytes"]) for r in back] == levels
    dds.register(spark)
    rows.coalesce(1).write.format("dds").option("path", str(tmp_path / "two")).mode("append").save()
    again = spark.read.format("dds").option("path", str(tmp_path / "two")).load().orderBy("level").collect()
    assert [bytes(r["bytes"]) for r in again] == levels


@pytest.mark.parametrize("kind", ["png", "bmp"])
def test_image_round_trip(spark, tmp_path, kind):
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    data = (images.encode_png if kind == "png" else images.encode_bmp)(rgb)
    assert images.dimensions(data[:64]) == (7, 5)
    assert (images.decode_png(data) if kind == "png" else images.decode_bmp(data)).tolist() == rgb.tolist()
    (tmp_path / f"a.{kind}").write_bytes(data)
    rows = images.read(spark, str(tmp_path)).collect()
    assert len(rows) == 35 and not any(r["alpha_ignored"] for r in rows)
    assert all(round(r["c1"] * 255) == rgb[r["y"], r["x"], 1] for r in rows)
    other = images.read_any(spark, str(tmp_path)).collect()
    assert sorted((r["y"], r["x"], round(r["c0"] * 255)) for r in other) == sorted((r["y"], r["x"], round(r["c0"] * 255)) for r in rows)
    planes = spark.createDataFrame([("p", int(y), int(x), *map(int, rgb[y, x])) for y in range(5) for x in range(7)], "path string, y int, x int, c0 int, c1 int, c2 int")
    assert bytes(images.encode(planes, kind).first()["content"]) == data


def test_undecodable_images_fail(spark, tmp_path):
    (tmp_path / "a.tga").write_bytes(b"not a picture")
    with pytest.raises(Exception, match="can't be decoded"):
        images.read_any(spark, str(tmp_path)).collect()


def test_undecodable_images_can_be_rows(spark, tmp_path):
    rgb = np.zeros((2, 3, 3), np.uint8)
    for name, data in (("a.png", images.encode_png(rgb)), ("b.png", images.encode_png(rgb)[:-9]), ("c.tga", b"not a picture"), ("d.bmp", images.encode_bmp(rgb))):
        (tmp_path / name).write_bytes(data)
    pixels, failed = images.read_checked(spark, str(tmp_path))
    assert pixels.count() == 12 and {r["path"][-5:] for r in pixels.collect()} == {"a.png", "d.bmp"}
    assert sorted(r["path"][-5:] for r in failed.collect()) == ["b.png", "c.tga"] and all(r["reason"] for r in failed.collect())


def test_materials_are_strict(spark, tmp_path):
    assert material.parse_text('[{"file": "a.png", "srgb": true}]')[1] is None
    for text in ('[{"file": "a", "file": "b"}]', '[{"file": "a", "colour": 1}]', "[]", "{", '[{"file": "a", "srgb": 1}]', '[{"srgb": true}]', '[{"file": "a", "normal_map": true, "srgb": true}]', '[{"file": "a", "filter": "cubic"}]'):
        assert material.parse_text(text)[1]
    assert "line 2" in material.parse_text("[\n{]")[1]
    (tmp_path / "m.json").write_text("﻿" + json.dumps([{"file": "a.png", "weight": 2}, {"file": "/abs/b.png"}]))
    rows = material.read(spark, str(tmp_path / "m.json")).orderBy("t").collect()
    assert rows[0]["source"].endswith(f"{tmp_path}/a.png") and rows[1]["source"] == "/abs/b.png" and rows[0]["weight"] == 2.0
    (tmp_path / "m.json").write_text("[{}]")
    with pytest.raises(Exception, match="no file"):
        material.read(spark, str(tmp_path / "m.json")).collect()


def test_descriptor_writes_what_it_reads(spark, tmp_path):
    latent = lambda f, n, w: {"file": f, "mip_count": 1, "mip_sizes": [[w, w]], "dxgi_format_id": 80, "dxgi_format": "BC4", "dequantise": {"lo": [-1.0] * n, "hi": [1.0] * n}}
    text = descriptor.build(8, 8, 1, 1, 1, [[1, 2, 3]] * 3, [0, 0, 0.5], [latent("a.dds", 1, 8), latent("b.dds", 1, 2)])
    (tmp_path / "x.json").write_text(text)
    found = descriptor.find(descriptor.read(spark, str(tmp_path)))
    assert descriptor.violations(found).count() == 0
    assert descriptor.summary(found).first()["bytes"] == 32 + 8
    assert sorted(r["file"] for r in descriptor.named_files(found).collect()) == ["a.dds", "b.dds"]
    with pytest.raises(ValueError):
        descriptor.build(8, 8, 1, 1, 1, [[float("nan")] * 3] * 3, [0, 0, 0], [])


def test_newer_files_win(spark):
    base = spark.createDataFrame([("d/a.dds", 1), ("d/b.dds", 5)], "path string, stamp int")
    extra = spark.createDataFrame([("e/a.dds", 2), ("e/b.dds", 4), ("e/c.dds", 1)], "path string, stamp int")
    assert sorted(r["path"] for r in descriptor.merge_sets(base, extra).collect()) == ["d/b.dds", "e/a.dds", "e/c.dds"]


def test_parsers(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("12", "1.5", "1,2", "64x32"), (" 12", "1.5x", "1,a", "0x5"), ("1e3", "1e400", "", "64")], "i string, d string, l string, s string")
    got = rows.select(parse_int(F.col("i")).alias("i"), parse_double(F.col("d")).alias("d"), parse_list(F.col("l"), "int").alias("l"), parse_size(F.col("s")).alias("s")).collect()
    assert [r["i"] for r in got] == [12, None, None] and [r["d"] for r in got] == [1.5, None, None]
    assert [r["l"] for r in got] == [[1, 2], None, None] and got[0]["s"]["a"] == 64 and got[1]["s"] is None and got[2]["s"] is None


def test_ingest_counts_every_file_once(spark, tmp_path):
    from rasterloom.streaming.ingest import image_stats, run_once

    rgb = np.full((2, 3, 3), 51, np.uint8)
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.png").write_bytes(images.encode_png(rgb))
        run_once(image_stats(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 6 and all(abs(r["mean"] - 0.2) < 1e-12 for r in rows)


# ---- assets: written, read back, decoded


def _planes(spark, n, w, h, levels, seed):
    from rasterloom.operators import resample as R

    size = R.geometry(w, h, levels)
    rng = np.random.default_rng(seed)
    rows = lambda k: [(p, x, y, *map(int, rng.integers(0, 256, n))) for p, *s in size for y in range(s[k + 1]) for x in range(s[k])]
    schema = "plane int, x int, y int, " + ", ".join(f"c{i} int" for i in range(n))
    return spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(2), schema), R.geometry_table(spark, size)


def _rows(df, digits=9):
    return sorted(tuple(round(v, digits) for v in r) for r in df.collect())


@pytest.mark.parametrize("n", [1, 3])
def test_asset_round_trip(spark, tmp_path, n):
    """Unpacked, every byte comes back; in blocks, no value moves by more than a block's coarsest step."""
    from pyspark.sql import functions as F

    from rasterloom.sources import asset

    l0, l1, size = _planes(spark, n, 17, 9, 1, n)
    m = 2 * n + n * n
    decoder = [[0.5 / (1 + i)] * m for i in range(3)], [0.1, 0.2, 0.3]
    grid = [-1.0 - 0.1 * i for i in range(n)], [1.0 + 0.3 * i for i in range(n)]
    for packed in (False, True):
        root = str(tmp_path / f"a{packed}")
        asset.write(l0, l1, size, *decoder, grid, grid, root, "m", packed=packed)
        got = asset.load(spark, root, "m.json")
        assert got.weights == decoder[0] and got.bias == decoder[1]
        back = lambda df: df.select("plane", "x", "y", *[F.round((F.col(f"c{i}") - grid[0][i]) / (grid[1][i] - grid[0][i]) * 255, 3).alias(f"c{i}") for i in range(n)])
        assert _rows(back(got.level1)) == _rows(l1)
        stored, want = _rows(back(got.level0)), _rows(l0)
        assert [r[:3] for r in stored] == [r[:3] for r in want]
        assert max(abs(a - b) for r, s in zip(stored, want, strict=True) for a, b in zip(r, s, strict=True)) <= (255 / 7 / 2 + 0.01 if packed else 0)
        assert asset.closure(got).filter("off_grid + not_closed > 0").count() == 0
        assert got.decode().count() == l0.count()
    quality = asset.quality(got, got.decode()).collect()
    assert {r["texture"] for r in quality} == {0, -1} and all(r["psnr"] == 100 for r in quality)


def test_assets_are_refused(spark, tmp_path):
    from pyspark.sql import functions as F

    from rasterloom.sources import asset

    l0, l1, size = _planes(spark, 1, 8, 8, 1, 5)
    write = lambda root, level1=l1, bias=(0.0, 0.0, 0.0), grid=([-1.0], [1.0]), bits=8: asset.write(l0, level1, size, [[0.1] * 3] * 3, list(bias), ([-1.0], [1.0]), grid, root, "m", bits)
    with pytest.raises(ValueError, match="finite"):
        write(str(tmp_path / "a"), bias=(0.0, float("nan"), 0.0))
    with pytest.raises(Exception, match="isn't closed"):
        write(str(tmp_path / "b"), level1=l1.withColumn("c0", F.lit(200)), bits=4)
    with pytest.raises(Exception, match="isn't closed"):
        write(str(tmp_path / "c"), grid=([0.5], [0.5]))
    root = str(tmp_path / "d")
    write(root)
    assert sorted(p.name for p in (tmp_path / "d").iterdir() if p.name[0] != ".") == ["m.json", "m_level0.dds", "m_level1.dds"]
    (tmp_path / "d/m_level1.dds").write_bytes((tmp_path / "d/m_level0.dds").read_bytes())
    with pytest.raises(Exception, match="other levels"):
        asset.load(spark, root, "m").level1.collect()
    (tmp_path / "d/m_level1.dds").unlink()
    with pytest.raises(ValueError, match="missing"):
        asset.load(spark, root, "m")
    text = (tmp_path / "d/m.json").read_text()
    (tmp_path / "d/m.json").write_text(text.replace('"block": 4', '"block": 8'))
    with pytest.raises(ValueError, match="block ratio"):
        asset.load(spark, root, "m")


@pytest.mark.parametrize("l0", ["bc8", "palette"])
def test_fitted_assets_decode_as_they_were_fitted(spark, tmp_path, l0):
    """Files of two fitted materials decode to the model's own error at the texel centres."""
    from pyspark.sql import functions as F

    from rasterloom import fixtures
    from rasterloom.functions.config import Options
    from rasterloom.operators import resample as R
    from rasterloom.plans import fit as P
    from rasterloom.sources import asset

    o = Options(c0=2, c1=3, l0=l0, bits0=(3,), bits1=6, rounds=4, k=0)
    planes = {kind: fixtures.pattern(spark, kind, 32, 16) for kind in ("gradient", "noise")}
    materials = [P.with_material(p, kind) for kind, p in planes.items()]
    dds.save_files(asset.fitted_files(P.fit(materials[0].unionByName(materials[1]), o), o), str(tmp_path))
    for kind, plane in planes.items():
        got = asset.load(spark, str(tmp_path), kind)
        assert asset.closure(got).filter("off_grid + not_closed > 0").count() == 0
        base = np.zeros((16, 32, 3))
        for r in plane.collect():
            base[r["y"], r["x"]] = [r["c0"], r["c1"], r["c2"]]
        model, _ = P.fit_planes(P.box_chain(base, got.size.count() - 1), o, [1.0] * 3)
        decoded = got.decode()
        for m, p in enumerate(model.planes):
            want = np.clip(P.residuals(model, p) + p.src, 0, 1)
            rows = decoded.filter(F.col("plane") == m).collect()
            assert len(rows) == want.shape[0] * want.shape[1]
            for r in rows:
                assert np.allclose(want[r["y"], r["x"]], [r["c0"], r["c1"], r["c2"]], atol=1e-6)
        chain = R.box_chain(plane, 32, 16, got.size.count() - 1)
        assert asset.quality(got, chain).count() == 2 * got.size.count()


def test_level_pictures(spark):
    from rasterloom import fixtures
    from rasterloom.operators import resample as R
    from rasterloom.sources import asset

    chain = R.box_chain(R.pack([fixtures.pattern(spark, "quadrants", 8, 8), fixtures.pattern(spark, "noise", 8, 8)]), 8, 8, 1)
    found = {r["path"]: images.decode_png(bytes(r["content"])) for r in asset.level_pictures(chain, "m", "src").collect()}
    assert sorted(found) == ["m_src_t0.png", "m_src_t0_M1.png", "m_src_t1.png", "m_src_t1_M1.png"]
    assert found["m_src_t0.png"].shape == (8, 8, 3) and found["m_src_t0.png"][0, 7].tolist() == [0, 0, 0] or found["m_src_t0.png"][0, 0].tolist() == [255, 255, 0]
    assert found["m_src_t1_M1.png"].shape == (4, 4, 3)


def _png(image, depth, colour, kinds, interlace):
    """A PNG written plainly: filter ``kinds`` in turn, one pass or seven."""
    import struct
    import zlib

    h, w, per = image.shape
    unit, body, turn = max(1, per * depth // 8), b"", 0
    for x0, y0, dx, dy in images._PASSES if interlace else ((0, 0, 1, 1),):
        part = image[y0::dy, x0::dx]
        if not part.size:
            continue
        above = [0] * -(-part.shape[1] * per * depth // 8)
        for row in part:
            if depth == 16:
                line = [b for v in row.ravel().tolist() for b in (v, 7)]
            elif depth == 8:
                line = row.ravel().tolist()
            else:
                bits = "".join(format(v, f"0{depth}b") for v in row.ravel().tolist())
                line = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
            kind, turn, out = kinds[turn % len(kinds)], turn + 1, []
            for i, v in enumerate(line):
                a, b, c = (line[i - unit], above[i], above[i - unit]) if i >= unit else (0, above[i], 0)
                p = a + b - c
                paeth = min((a, b, c), key=lambda q: abs(p - q))
                out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
            body += bytes([kind, *out])
            above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    return images._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlace", [0, 1])
@pytest.mark.parametrize(("depth", "colour", "per"), [(8, 2, 3), (8, 6, 4), (8, 0, 1), (16, 2, 3), (8, 4, 2), (4, 0, 1), (1, 0, 1)])
def test_png_filters_and_passes(interlace, depth, colour, per):
    rng = np.random.default_rng(depth + per)
    for w, h in ((13, 11), (1, 1), (3, 9), (8, 2)):
        image = rng.integers(0, min(256, 1 << depth), (h, w, per))
        got = images.decode_png(_png(image, depth, colour, (1, 3, 4, 2, 0), interlace))
        assert got.tolist() == (image * (255 // ((1 << depth) - 1) if depth < 8 else 1)).tolist()


def test_sizes_of_files(spark):
    rows = spark.createDataFrame([("a", bytearray(images.encode_png(np.zeros((5, 7, 3), np.uint8)))), ("b", bytearray(b"no picture")), ("c", None)], "path string, content binary")
    assert sorted((r["path"], r["width"], r["height"]) for r in images.sizes(rows).collect()) == [("a", 7, 5), ("b", None, None), ("c", None, None)]


def _runs(row: bytes, unit: int = 1) -> list[tuple[bytes, int]]:
    """A row as (value, times) of equal neighbours, at most 120 each."""
    out = []
    for i in range(0, len(row), unit):
        value = row[i : i + unit]
        if out and out[-1][0] == value and out[-1][1] < 120:
            out[-1] = (value, out[-1][1] + 1)
        else:
            out.append((value, 1))
    return out


def _other_formats(rgb: np.ndarray) -> dict[str, bytes]:
    """One picture in every format that keeps bytes as they are, plain and in runs."""
    h, w = rgb.shape[:2]
    bgr = np.ascontiguousarray(rgb[..., ::-1])
    alpha = np.concatenate([bgr, np.full((h, w, 1), 255, np.uint8)], 2)
    colours, index = np.unique(bgr.reshape(-1, 3), axis=0, return_inverse=True)
    index = index.astype(np.uint16 if len(colours) > 256 else np.uint8)
    tga = lambda kind, bits, flags, n=0: struct.pack("<BBBHHBHHHHBB", 3, int(n > 0), kind, 0, n, 24 if n else 0, 0, 0, w, h, bits, flags) + b"own"
    psd = struct.pack(">4sH6xHIIHH", b"8BPS", 1, 3, h, w, 8, 3) + struct.pack(">I", 0) + struct.pack(">I4x", 4) + struct.pack(">I", 0)
    pack = lambda row: b"".join(bytes([(1 - n) & 255]) + v if n > 1 else b"\x00" + v for v, n in _runs(row))
    planes = [[rgb[y, :, c].tobytes() for y in range(h)] for c in range(3)]
    packed = [[pack(row) for row in plane] for plane in planes]
    pic = b"\x53\x80\xf6\x34" + bytes(84) + b"PICT" + struct.pack(">HHfHH", w, h, 1.0, 3, 0)
    pure = lambda row: b"".join(bytes([n]) + v for v, n in _runs(row, 3))
    mixed = lambda row: b"".join((bytes([127 + n]) if i % 2 else b"\x80" + struct.pack(">H", n)) + v if n > 1 else b"\x00" + v for i, (v, n) in enumerate(_runs(row, 3)))
    return {
        "plain.tga": tga(2, 24, 0) + bgr[::-1].tobytes(),
        "top.tga": tga(2, 32, 0x28) + alpha.tobytes(),
        "mirrored.tga": tga(2, 24, 0x30) + np.ascontiguousarray(bgr[:, ::-1]).tobytes(),
        "packets.tga": tga(10, 24, 0x20) + b"".join(bytes([127 + n]) + v for v, n in _runs(bgr.tobytes(), 3)),
        "mapped.tga": tga(1, 8 * index.itemsize, 0x20, len(colours)) + colours.tobytes() + index.tobytes(),
        "plain.psd": psd + b"\0\0" + b"".join(b"".join(p) for p in planes),
        "packed.psd": psd + b"\0\1" + b"".join(struct.pack(">H", len(r)) for p in packed for r in p) + b"".join(b"".join(p) for p in packed),
        "plain.pic": pic + bytes([0, 8, 0, 0xE0]) + rgb.tobytes(),
        "pure.pic": pic + bytes([0, 8, 1, 0xE0]) + b"".join(pure(row.tobytes()) for row in rgb),
        "mixed.pic": pic + bytes([0, 8, 2, 0xE0]) + b"".join(mixed(row.tobytes()) for row in rgb),
        "plain.ppm": b"P6\n# said by nobody\n%d %d\n255\n" % (w, h) + rgb.tobytes(),
        "deep.pnm": b"P6 %d %d 65535\n" % (w, h) + np.stack([rgb, 255 - rgb], 3).tobytes(),
    }


def test_other_formats(spark, tmp_path):
    rgb = np.zeros((5, 150, 3), np.uint8)
    rgb[:] = np.random.default_rng(7).integers(0, 256, (5, 50, 3), np.uint8).repeat(3, 1)
    rgb[2, :, :], rgb[4, ::2, 1] = 9, 77
    files = _other_formats(rgb)
    for name, data in files.items():
        assert images.dimensions(data[:256]) == (150, 5), name
        assert images.decode(data)[..., :3].tolist() == rgb.tolist(), name
        (tmp_path / name).write_bytes(data)
    grey = b"P5 150 5 255\n" + rgb[..., 0].tobytes()
    assert images.decode(grey)[..., 0].tolist() == rgb[..., 0].tolist()
    rows = images.read(spark, str(tmp_path)).groupBy("path").agg({"*": "count", "c1": "sum", "x": "max", "y": "max"}).collect()
    assert len(rows) == len(files)
    for r in rows:
        assert (r["count(1)"], r["max(x)"], r["max(y)"]) == (750, 149, 4) and r["sum(c1)"] == pytest.approx(rgb[..., 1].sum() / 255)
    (tmp_path / "short.ppm").write_bytes(files["plain.ppm"][:-1])
    with pytest.raises(Exception, match="short.ppm can't be decoded"):
        images.read(spark, str(tmp_path), "*.ppm").collect()
    for name, data in files.items():
        with pytest.raises(Exception):
            images.decode(data[: len(data) // 2])


def test_strips_of_a_picture(monkeypatch):
    monkeypatch.setattr(images, "STRIP", 16)
    rgb = np.arange(7 * 5 * 3, dtype=np.uint8).reshape(7, 5, 3)
    parts = list(images._pixels("a", rgb))
    assert [len(p) for p in parts] == [15, 15, 5] and [p["y"].max() for p in parts] == [2, 5, 6]
    assert np.concatenate([p[["c0", "c1", "c2"]].to_numpy() for p in parts]).tolist() == (rgb.reshape(-1, 3) / 255.0).tolist()


def test_high_dynamic_range():
    """Flat lines and lines in runs give the same bytes: x to the power of 1 / 2.2."""
    rng = np.random.default_rng(3)
    rgbe = rng.integers(0, 256, (3, 9, 4), np.uint8)
    rgbe[..., 3] = rng.choice([0, 120, 127, 128, 129, 136, 140], (3, 9))
    head = b"#?RADIANCE\n# by hand\nFORMAT=32-bit_rle_rgbe\n\n-Y 3 +X 9\n"
    runs = b"".join(b"\2\2\0\x09" + b"".join(bytes([128 + n]) + v if n > 1 else b"\1" + v for c in range(4) for v, n in _runs(row[:, c].tobytes())) for row in rgbe)
    want = [[[0 if e == 0 else min(255, int((v * 2.0 ** (int(e) - 136)) ** (1 / 2.2) * 255 + 0.5)) for v in px] for *px, e in row.tolist()] for row in rgbe]
    assert images.decode(head + runs).tolist() == want
    rgbe[0, 0, 0] = 1  # not the mark of a line in runs
    want[0][0][0] = 0 if rgbe[0, 0, 3] == 0 else min(255, int((2.0 ** (int(rgbe[0, 0, 3]) - 136)) ** (1 / 2.2) * 255 + 0.5))
    assert images.decode(head + rgbe.tobytes()).tolist() == want
    assert images.dimensions(head) == (9, 3)


def test_white_matte_and_five_bits():
    psd = struct.pack(">4sH6xHIIHH", b"8BPS", 1, 4, 1, 3, 8, 3) + bytes(12) + b"\0\0"
    got = images.decode(psd + bytes([200, 200, 200, 90, 255, 0, 255, 255, 255, 128, 255, 0]))
    assert got.tolist() == [[[int(200 / (128 / 255) + 255 * (1 - 255 / 128)), 0, 255, 128], [200, 255, 255, 255], [200, 0, 255, 0]]]
    tga = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 2, 1, 16, 0x20) + struct.pack("<HH", 31 << 10 | 5, 16 << 5)
    assert images.decode(tga).tolist() == [[[255, 0, 5 * 255 // 31], [0, 16 * 255 // 31, 0]]]


def _slab_case(spark, root):
    """Two files of three levels, 21 x 37 texels of four bytes and 30 x 22 in blocks; their levels as bytes."""
    rng = np.random.default_rng(3)
    files, rows = {}, []
    for name, w, h, dxgi in (("a.dds", 21, 37, 28), ("deep/b.dds", 30, 22, 80)):
        levels = []
        for level, lw, lh, _, stride, n in dds.layout(w, h, dxgi, 3):
            data = rng.integers(0, 256, stride * n, dtype=np.uint8).tobytes()
            levels.append(data)
            rows += [(name, level, lw, lh, dxgi, 4, 3, y, 1, bytearray(data[y * stride : (y + 1) * stride])) for y in range(n)]
        files[name] = dds.pack(w, h, dxgi, levels)
    return files, spark.createDataFrame(rows, dds.SLAB).repartition(5)


def test_slabs_are_written_and_read_by_range(spark, tmp_path, monkeypatch):
    files, slabs = _slab_case(spark, tmp_path)
    root = f"file:{tmp_path}/out"
    dds.save_slabs(slabs, root)
    assert {p.relative_to(tmp_path / "out").as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == files
    back = dds.read_slabs(spark, root, strict=True, slab_bytes=200)
    got = back.orderBy("path", "level", "row").collect()
    assert len(got) > 20 and {len(r["bytes"]) for r in got} != {0}
    whole = {}
    for r in got:
        whole[r["path"].split("/out/")[1]] = whole.get(r["path"].split("/out/")[1], b"") + bytes(r["bytes"])
    assert whole == {name: data[dds.HEADER :] for name, data in files.items()}
    # Asked for level 2 of one file, its bytes alone are read: counted in the plan and where they are read.
    reader = dds.SlabReader({"path": root, "slabBytes": "200", "levels": "2", "rows": "2:9", "pathGlobFilter": "a.*"})
    wanted = reader.partitions()
    opened = []
    store, _ = dds._store(root)
    monkeypatch.setattr(dds, "_store", lambda _: (type("Counting", (), {"open_input_file": staticmethod(lambda p: opened.append(p) or store.open_input_file(p))}), ""))
    read = sum(len(next(reader.read(p))[-1]) for p in wanted)
    monkeypatch.undo()
    assert read == 7 * 5 * 4 and set(opened) == {wanted[0].told[0]} and len(opened) == len(wanted)
    asked = dds.read_slabs(spark, root, levels=[2], names="a.dds", slab_bytes=200)
    assert b"".join(bytes(r["bytes"]) for r in asked.orderBy("row").collect()) == files["a.dds"][-5 * 9 * 4 :]
    assert back.filter("level = 2").count() < back.count() == len(got)  # a filter of one query is none of the next


@pytest.mark.parametrize("spoil", ["level = 1 and row = 3", "level = 0 and row = 0"])
def test_a_failed_job_leaves_no_file(spark, tmp_path, spoil):
    files, slabs = _slab_case(spark, tmp_path)
    with pytest.raises(Exception, match="out of place|lacks rows|doesn't begin"):
        dds.save_slabs(slabs.filter(f"not (path = 'a.dds' and {spoil})"), f"file:{tmp_path}/out")
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_damaged_files_are_named(spark, tmp_path):
    files, _ = _slab_case(spark, tmp_path)
    (tmp_path / "bad.dds").write_bytes(files["a.dds"][:-1])
    with pytest.raises(Exception, match="bad.dds: length is"):
        dds.read_slabs(spark, f"file:{tmp_path}").count()


@pytest.mark.parametrize("kind", ["png", "bmp"])
def test_pictures_in_runs(spark, tmp_path, monkeypatch, kind):
    """Runs of three rows, one of them without a pixel, are the file of the whole picture; readers hold a strip of it."""
    rgb = np.random.default_rng(3).integers(0, 256, (17, 5, 3)).astype(np.uint8)
    rgb[5:12] = 0
    rows = [("d/p." + kind, x, y, *map(int, rgb[y, x])) for y in range(17) for x in range(5) if not 5 <= y < 12]
    planes = spark.createDataFrame(rows, "path string, x int, y int, c0 int, c1 int, c2 int")
    images.save(planes.repartition(3), f"file:{tmp_path}", kind, pixels=17)
    data = (tmp_path / f"d/p.{kind}").read_bytes()
    assert images.decode(data).tolist() == rgb.tolist() and list(tmp_path.glob("d/*")) == [tmp_path / f"d/p.{kind}"]
    read = images.read(spark, str(tmp_path / "d")).collect()
    assert len(read) == 85 and all(round(r["c2"] * 255) == rgb[r["y"], r["x"], 2] for r in read)
    monkeypatch.setattr(images, "STRIP", 40)
    parts = list(images.strips(str(tmp_path / f"d/p.{kind}")))
    assert max(len(p) for p in parts) <= 9 and np.concatenate(parts).tolist() == rgb.tolist()
    images.save(planes, f"file:{tmp_path}/whole", kind)
    assert (tmp_path / f"whole/d/p.{kind}").read_bytes() == (images.encode_png if kind == "png" else images.encode_bmp)(rgb)


def test_cut_streams(spark, tmp_path, monkeypatch):
    """A crop keeps the rows that it needs, also of strips that begin or end beside them."""
    from rasterloom.sources import crop

    rgb = np.random.default_rng(4).integers(0, 256, (30, 6, 3)).astype(np.uint8)
    monkeypatch.setattr(images, "STRIP", 40)
    for name, data in (("a.png", images.encode_png(rgb)), ("a.bmp", images.encode_bmp(rgb))):
        (tmp_path / name).write_bytes(data)
        for size in ((4, 9), (9, 40), (6, 30)):
            got, told = crop.cropped(str(tmp_path / name), *size, "center", (1, -2))
            assert told == (6, 30) and got.tolist() == crop.fitted(rgb, *size, "center", (1, -2)).tolist()


def test_containers_beyond_a_cards_extent(spark, tmp_path):
    """An asset's file may be higher than a texture can be; only a strict reader refuses it."""
    data = dds.pack(4, 20000, 61, [bytes(i % 251 for i in range(80000))])
    (tmp_path / "a.dds").write_bytes(data)
    rows = dds.read_slabs(spark, str(tmp_path / "a.dds"), slab_bytes=30000).orderBy("row").collect()
    assert len(rows) == 3 and b"".join(bytes(r["bytes"]) for r in rows) == data[dds.HEADER :]
    with pytest.raises(ValueError, match="out of range"):
        dds.parse_header(data[: dds.HEADER], strict=True)
