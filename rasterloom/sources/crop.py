"""A material out of unrelated pictures: all cropped or expanded to one size, written as PNGs with their material file.

A picture keeps its kind: grey, grey and alpha, RGB, RGB and alpha; palettes become RGB (with alpha if they have
any), fewer than 8 bits of grey are stretched to 8, 16 bits keep the high byte. At most six pictures make
a material, each in a task of its own, which holds no more of a PNG or a bitmap than it keeps; other formats are decoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.resample import fit_axis
from rasterloom.schema import MAX_TEXTURES
from rasterloom.sources import dds, images

#: Weights of 16 bits that make grey of red, green and blue (ITU-R 601), and the half that rounds.
GREY, HALF = (19595, 38470, 7471), 0x8000
_CUT = "n int, path string, content binary, source_width int, source_height int, channels int"


def to_grey(image: np.ndarray) -> np.ndarray:
    """(h, w, 1) luma of a picture of any kind, its alpha dropped."""
    if image.shape[2] <= 2:
        return image[..., :1]
    return ((image[..., :3].astype(np.int64) @ np.array(GREY) + HALF) >> 16).astype(np.uint8)[..., None]


def fitted(image: np.ndarray, width: int, height: int, anchor: str = "center", offset: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Cropped where it is longer, its last row or column repeated where it is shorter."""
    h, w = image.shape[:2]
    (x0, nw), (y0, nh) = fit_axis(w, width, anchor, offset[0]), fit_axis(h, height, anchor, offset[1])
    return np.pad(image[y0 : y0 + nh, x0 : x0 + nw], [(0, height - nh), (0, width - nw), (0, 0)], mode="edge")


def cropped(path: str, width: int, height: int, anchor: str, offset: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """``fitted`` of a picture's file, and the picture's width and height; of a stream only the rows that are kept are held."""
    store, at = dds._store(path)
    with store.open_input_file(at) as f:
        size = images.dimensions(f.read(65536))
    if size is None:
        raise ValueError("not a picture that is known")
    (x0, nw), (y0, nh) = fit_axis(size[0], width, anchor, offset[0]), fit_axis(size[1], height, anchor, offset[1])
    kept, top = [], 0
    for part in images.strips(path):
        a, b = max(0, y0 - top), max(0, y0 + nh - top)
        kept.append(part[a:b, x0 : x0 + nw].copy())
        top += len(part)
    return np.pad(np.concatenate(kept), [(0, height - nh), (0, width - nw), (0, 0)], mode="edge"), size


def crop_set(spark: SparkSession, paths: Sequence[str], width: int, height: int, root: str, prefix: str = "t", anchor: str = "center", offset: tuple[int, int] = (0, 0), material: str | None = None, gray: bool = False, gray_first: bool = False) -> DataFrame:
    """Writes <prefix>1.png and so on below ``root`` (and the material's JSON as ``material``); what was done, a row per picture."""
    if not 1 <= len(paths) <= MAX_TEXTURES:
        raise ValueError(f"1 to {MAX_TEXTURES} pictures make a material")
    if width < 1 or height < 1 or anchor not in ("center", "topleft"):
        raise ValueError("a size is positive, an anchor center or topleft")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for n, path in zip(pdf["n"], pdf["path"], strict=True):
                try:
                    image, (w, h) = cropped(path, width, height, anchor, offset)
                except Exception as e:
                    raise ValueError(f"{path} can't be decoded: {e}") from e
                kept = to_grey(image) if gray or (gray_first and n == 1) else image
                rows.append((n, f"{prefix}{n}.png", images.encode_png(kept), w, h, kept.shape[2]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CUT.split(", ")])

    given = spark.createDataFrame([(i, p) for i, p in enumerate(paths, 1)], "n int, path string").repartition(len(paths), "n")
    made = given.mapInPandas(cut, _CUT)
    from rasterloom.session import stored

    made = stored(made, "crop-set")
    dds.save_files(made, root)
    if material:
        rows = [{"file": f"{prefix}{i}.png", "type": "", "filter": "mitchell", "edge": "clamp", "weight": 1, "rgb_weights": [1, 1, 1]} for i in range(1, len(paths) + 1)]
        text = "[\n" + ",\n".join("  " + json.dumps(r) for r in rows) + "\n]\n"
        dds.save_files(spark.createDataFrame([(material, bytearray(text.encode()))], "path string, content binary"), root)
    return made.select("n", F.col("path").alias("file"), "source_width", "source_height", "channels", F.lit(width).alias("width"), F.lit(height).alias("height"))
