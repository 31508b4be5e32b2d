"""Micro-batch ingestion of image folders. An addition: it feeds the batch operators, nothing more.

New files of a folder are decoded as they arrive and their per-image statistics go
to a sink; the file source's log makes every file count once, also after a restart
from the same checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rasterloom.sources.images import decode, to_rgb

STATS = "path string, modificationTime timestamp, width int, height int, channel int, mean double, least double, most double"


def image_stats(spark: SparkSession, folder: str, pattern: str = "*.{png,bmp,tga,psd,hdr,pic,pgm,ppm,pnm}") -> DataFrame:
    """A streaming row per channel of every arriving image."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, stamp, content in zip(pdf["path"], pdf["modificationTime"], pdf["content"], strict=True):
                data = bytes(content)
                rgb = to_rgb(decode(data))[0] / 255.0
                rows += [(path, stamp, rgb.shape[1], rgb.shape[0], c, float(np.mean(rgb[..., c])), float(rgb[..., c].min()), float(rgb[..., c].max())) for c in range(3)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATS.split(", ")])

    return files.select("path", "modificationTime", "content").mapInPandas(run, STATS)


def run_once(stats: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, then stop; the next call takes what is new."""
    return stats.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
