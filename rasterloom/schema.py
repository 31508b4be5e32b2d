"""Schemas and limits of the data model.

A *plane* is a table with key columns (``plane``, and ``material_id`` where several
materials share a table), ``x``, ``y`` and one column per channel, ``c0``, ``c1``, ...
Channels are columns, not arrays, so every operator stays inside generated code
and a projection reads only the channels it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The limits of the format.
MAX_TEXTURES, MAX_OUTPUTS, MAX_FEATURES, MAX_CHANNELS = 6, 18, 24, 4
BLOCK, LOD_SHIFT, MAX_MIPS, MAX_EXTENT = 4, 2, 12, 16384
WEIGHT_RANGE = (1e-6, 128.0)

KEYS = ("plane",)

TEXTURE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("filter", T.StringType()),
        T.StructField("srgb", T.BooleanType()),
        T.StructField("edge", T.StringType()),
        T.StructField("normal_map", T.BooleanType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("rgb_weights", T.ArrayType(T.DoubleType())),
    ]
)
DDS_LEVEL = "path string, level int, width int, height int, dxgi int, channels int, bytes binary"
BLOCKS = "plane int, bx int, by int, ch int, r0 int, r1 int, sel array<int>"
GEOMETRY = "plane int, w0 int, h0 int, w1 int, h1 int"

DESCRIPTOR = (
    "format string, source struct<width:int,height:int,padded:boolean,padded_width:int,padded_height:int,"
    "inputs:array<struct<file:string,type:string,filter:string,srgb:boolean,edge:string,normal_map:boolean,weight:double,rgb_weights:array<double>>>>, "
    "decode struct<width:int,height:int,textures_out:int>, block int, lod_bias_level1 int, sampling string, "
    "textures array<struct<file:string,files:array<string>,level:int,width:int,height:int,dxgi_format:string,dxgi_format_id:int,channels_used:int,"
    "channels_stored:int,bc_palette:string,bits_per_channel:array<int>,mip_count:int,mip_sizes:array<array<int>>,texel:string,"
    "dequantise:struct<kind:string,palette:array<array<double>>,lo:array<double>,hi:array<double>,levels:string,note:string>>>, "
    "decoder struct<type:string,terms:string,C0:int,C1:int,features:string,nin:int,nout:int,output:string,hidden:array<int>,activation:string,leak:double,"
    "layers:array<struct<rows:int,cols:int,weights:array<double>,bias:array<double>>>>"
)


def channels(df: DataFrame) -> list[str]:
    """The channel columns of a plane, in order."""
    own = [c for c in df.columns if c[:1] == "c" and c[1:].isdigit()]
    return sorted(own, key=lambda c: int(c[1:]))
