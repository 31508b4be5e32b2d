"""``python -m rasterloom a.png b.png -o folder --c0 1``: pictures, or a material file, to an asset."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import config


def planes(spark: SparkSession, inputs: Sequence[str]) -> tuple[DataFrame, int, int, int, str]:
    """All textures as one plane of 3 channels each, its extent, their number, and the material's name."""
    from rasterloom.operators import resample as R
    from rasterloom.sources import images, material

    if len(inputs) == 1 and inputs[0].endswith(".json"):
        rows = material.read(spark, inputs[0]).orderBy("t").select("source").collect()  # six at most
        paths = [r["source"] for r in rows]
    else:
        paths = list(inputs)
    textures = []
    for path in paths:
        textures.append(images.read(spark, path, "*").select(F.lit(0).alias("plane"), "x", "y", "c0", "c1", "c2"))
    sizes = {tuple(t.agg(F.max("x") + 1, F.max("y") + 1).first()) for t in textures}
    if len(sizes) > 1:
        raise ValueError(f"the textures have different sizes: {sorted(sizes)}")
    (w, h), = sizes
    name = inputs[0].replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return R.pack(textures), w, h, len(textures), name


def main(argv: Sequence[str], spark: SparkSession | None = None) -> int:
    from rasterloom.operators.aggregate import output_weights
    from rasterloom.operators.resample import pad
    from rasterloom.plans import encode as E
    from rasterloom.plans import fit as P
    from rasterloom.session import session
    from rasterloom.sources import asset, dds, images

    try:
        options, inputs, other = config.parse_options(argv)
        spark = spark or session()
        plane, w, h, textures, name = planes(spark, inputs)
        wrong = config.violations(options, textures)
        if wrong:
            raise ValueError("; ".join(wrong))
    except ValueError as e:
        print(f"rasterloom: {e}", file=sys.stderr)
        return 2
    root, name = other.get("out", "."), other.get("name", name)
    if any(config.same_file(f"{root}/{name}.json", i) for i in inputs):
        print(f"rasterloom: {name}.json would overwrite an input", file=sys.stderr)
        return 2
    if "quiet" not in other:
        print(config.banner(options, textures, w, h))
    if "tiles" in other:
        triples = options.rgb_weights * textures if len(options.rgb_weights) == 1 else options.rgb_weights
        cw = output_weights(options.weights or (1.0,) * textures, triples or ((1.0, 1.0, 1.0),) * textures)
        chain, sizes = E.chain_of(plane, w, h, name, options)
        got = E.encode(chain, sizes, cw, options)
        asset.write_encoded(got, sizes, root, options)
        source = chain.drop("material_id")
    else:
        fitted = P.fit(P.with_material(plane, name), options)
        dds.save_files(asset.fitted_files(fitted, options), root)
        source = pad(plane, w, h)[0]
    found = asset.load(spark, root, name)
    if "png" in other:
        images.save(asset.level_pixels(found.decode(), name, "recon"), root)
    if "quiet" not in other:
        for r in asset.quality(found, source).filter("texture >= 0").orderBy("plane", "texture").collect():  # a row per level and texture
            print(f"level {r['plane']}, texture {r['texture']}: {r['psnr']:.2f} dB")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
