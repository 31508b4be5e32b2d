"""The command line."""

from __future__ import annotations

import json

import numpy as np
import pytest

from rasterloom.__main__ import main
from rasterloom.functions import config as C
from rasterloom.sources import images


def test_options_from_words():
    o, inputs, other = C.parse_options(["a.png", "--c0", "1", "--bits0", "2,3", "--mips", "0", "--tol", "1e-3", "--l0", "palette", "--rgb-weights", "1,2,3,1,1,1", "-o", "out", "--tiles", "b.png", "--quiet"])
    assert (o.c0, o.bits0, o.mips, o.tol, o.l0, o.rgb_weights) == (1, (2, 3), False, 1e-3, "palette", ((1.0, 2.0, 3.0), (1.0, 1.0, 1.0)))
    assert inputs == ["a.png", "b.png"] and other == {"out": "out", "tiles": "yes", "quiet": "yes"}
    for words in (["a.png", "--c0"], ["a.png", "--c0", "x"], ["a.png", "--mips", "2"], ["a.png", "--nothing", "1"], ["--c0", "1"], ["a.png", "--rgb-weights", "1,2"]):
        with pytest.raises(ValueError):
            C.parse_options(words)
    assert C.same_file("a/../b.json", "./b.json") and not C.same_file("a.json", "b.json")
    assert "--c0 1" in C.banner(C.Options(c0=1), 2, 8, 8) and "2 textures of 8 x 8" in C.banner(C.Options(), 2, 8, 8)


def test_pictures_to_an_asset(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    for name in ("a", "b"):
        (tmp_path / f"{name}.png").write_bytes(images.encode_png(rng.integers(0, 256, (36, 40, 3)).astype(np.uint8)))
    (tmp_path / "set.json").write_text(json.dumps([{"file": "a.png"}, {"file": "b.png"}]))
    out = tmp_path / "out"
    common = ["--c0", "1", "--c1", "2", "--rounds", "1", "--mips", "0", "--bc-outer", "0", "--bc-refine", "1", "-o", f"file:{out}"]
    assert main([str(tmp_path / "set.json"), *common, "--png"], spark) == 0
    said = capsys.readouterr().out
    assert "2 textures of 40 x 36" in said and "level 0, texture 1" in said
    names = {p.name for p in out.iterdir()}
    assert {"set.json", "set_level0.dds", "set_level1.dds", "set_recon_t0.png", "set_recon_t1.png"} <= names
    assert main([str(tmp_path / "a.png"), *common, "--name", "one", "--tiles", "--quiet"], spark) == 0
    assert {"one.json", "one_level0.dds", "one_level1.dds"} <= {p.name for p in out.iterdir()}
    assert main([str(tmp_path / "set.json"), "-o", str(tmp_path), "--c0", "1"], spark) == 2
    assert main([str(tmp_path / "a.png"), "--c0", "9"], spark) == 2
    assert "overwrite" in capsys.readouterr().err
