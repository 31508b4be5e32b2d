"""Settings: parsing, precedence, validation. Tables stay tables; one run's options are a dataclass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.schema import MAX_CHANNELS, MAX_TEXTURES, WEIGHT_RANGE

FILTERS = ("default", "box", "mitchell", "catmullrom")
EDGES = ("clamp", "wrap")


@dataclass(frozen=True)
class Options:
    """One fit's options, with the defaults of the format."""

    c0: int = 2
    c1: int = 4
    l0: str = "bc8"  # or palette
    bits0: tuple[int, ...] = (3,)
    bits1: int = 8
    bc_refine: int = 4
    bc_refine_after: int = 0
    bc_outer: int = 2
    mips: bool = True
    mip_min: int = 8
    k: int = 4
    rounds: int = 20
    tol: float = 1e-4
    q1_start: int = 3
    q1_sweeps: int = 4
    q1_range: str = "pct"
    init: str = "box"
    init0: str = "residual"
    init0_scope: str = "base"
    weights: tuple[float, ...] = ()
    rgb_weights: tuple[tuple[float, float, float], ...] = ()
    mip_weight: str = "pixels"
    mip_mix: float = 0.5
    ridge: float = 1e-4
    sweeps: int = 2

    @property
    def palette_bits(self) -> tuple[int, ...]:
        return self.bits0 * self.c0 if len(self.bits0) == 1 else self.bits0


def violations(o: Options, textures: int) -> list[str]:
    """Every rule that the options break, as sentences; empty if they are fine."""
    rules = [
        (1 <= textures <= MAX_TEXTURES, f"1 to {MAX_TEXTURES} textures"),
        (1 <= o.c0 <= MAX_CHANNELS, f"c0 is 1 to {MAX_CHANNELS}"),
        (1 <= o.c1 <= MAX_CHANNELS, f"c1 is 1 to {MAX_CHANNELS}"),
        (o.l0 in ("bc8", "palette"), "l0 is bc8 or palette"),
        (len(o.bits0) in (1, o.c0) and all(1 <= b <= 4 for b in o.bits0), "bits0 has one entry, or one per channel, of 1 to 4"),
        (4 <= o.bits1 <= 8, "bits1 is 4 to 8"),
        (min(o.bc_refine, o.bc_refine_after, o.bc_outer) >= 0, "pack refinement counts aren't negative"),
        (o.mip_min >= 4, "mip_min is at least 4"),
        (o.k in (0, 1, 2, 4), "k is 0, 1, 2 or 4"),
        (o.rounds >= 1 and o.tol >= 0, "rounds is at least 1 and tol isn't negative"),
        (o.q1_start >= 0 and o.q1_sweeps >= 1 and o.q1_range in ("minmax", "pct"), "q1_start, q1_sweeps and q1_range are in their ranges"),
        (o.init in ("box", "pca"), "init is box or pca"),
        (o.init0 in ("residual", "texture", "luma") and o.init0_scope in ("base", "chain"), "init0 is residual, texture or luma, its scope base or chain"),
        (len(o.weights) in (0, textures), "weights has one entry per texture or none"),
        (len(o.rgb_weights) in (0, 1, textures), "rgb_weights has one triple, one per texture, or none"),
        (all(w >= 0 for w in o.weights) and (not o.weights or any(w > 0 for w in o.weights)), "weights aren't negative and not all zero"),
        (o.mip_weight in ("uniform", "sqrt", "pixels") and 0 <= o.mip_mix <= 1 and not (o.mips and o.mip_mix == 1), "mip_weight is uniform, sqrt or pixels; mip_mix is in [0, 1], below 1 with mips"),
        (o.ridge >= 0 and o.sweeps >= 1, "ridge isn't negative and sweeps is at least 1"),
    ]
    return [text for good, text in rules if not good]


def clamp_weight(w: Column) -> Column:
    """Positive weights into the allowed range; 0 stays 0."""
    lo, hi = WEIGHT_RANGE
    return F.when(w <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), w)))


def parse_int(text: Column) -> Column:
    """The whole string as an integer, else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def parse_double(text: Column) -> Column:
    """The whole string as a finite number, else null."""
    value = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parse_list(text: Column, kind: str) -> Column:
    """A comma list of int, double or string; null if any part isn't one."""
    parts = F.split(text, ",")
    if kind == "string":
        return parts
    values = F.transform(parts, {"int": parse_int, "double": parse_double}[kind])
    return F.when(F.forall(values, lambda v: v.isNotNull()), values)


def parse_pair(text: Column, separator: str) -> Column:
    """Two integers as struct(a, b), else null: ``64x32`` or ``3,-1``."""
    m = rf"^(-?[0-9]+){separator}(-?[0-9]+)$"
    return F.when(text.rlike(m), F.struct(F.regexp_extract(text, m, 1).cast("int").alias("a"), F.regexp_extract(text, m, 2).cast("int").alias("b")))


def parse_size(text: Column) -> Column:
    pair = parse_pair(text, "x")
    return F.when((pair["a"] > 0) & (pair["b"] > 0), pair)


def list_count_ok(values: Column, textures: int) -> Column:
    return F.size(F.coalesce(values, F.array())).isin(0, textures)


def merge_settings(textures: DataFrame, given: DataFrame) -> DataFrame:
    """One row per texture: command line over file over default, each with where it came from.

    ``textures`` has t and the file's settings (null: not set), ``given`` t and the
    command line's filter and weight. A srgb, wrap or normal-map setting without a
    filter implies the box filter.
    """
    own = given.select("t", F.col("filter").alias("__f"), F.col("weight").alias("__w"))
    rows = textures.join(own, "t", "left")
    implied = F.coalesce(F.col("srgb"), F.lit(False)) | (F.coalesce(F.col("edge"), F.lit("clamp")) == "wrap") | F.coalesce(F.col("normal_map"), F.lit(False))
    source = lambda line, file: F.when(F.col(line).isNotNull(), "command line").when(F.col(file).isNotNull(), "file").otherwise("default")
    asked = F.coalesce("__f", "filter")
    return rows.select(
        "t",
        F.when(asked.isNull() & implied, "box").otherwise(F.coalesce(asked, F.lit("default"))).alias("filter"),
        F.when(asked.isNull() & implied, "implied").otherwise(source("__f", "filter")).alias("filter_from"),
        F.coalesce("srgb", F.lit(False)).alias("srgb"),
        F.coalesce("edge", F.lit("clamp")).alias("edge"),
        F.coalesce("normal_map", F.lit(False)).alias("normal_map"),
        clamp_weight(F.coalesce("__w", "weight", F.lit(1.0))).alias("weight"),
        source("__w", "weight").alias("weight_from"),
    )


def setting_errors(merged: DataFrame) -> DataFrame:
    """(t, error) of every broken rule of merged settings."""
    rules = [
        (~F.col("filter").isin(*FILTERS), "unknown filter"),
        (~F.col("edge").isin(*EDGES), "unknown edge"),
        (F.col("srgb") & F.col("normal_map"), "a normal map isn't srgb"),
        (F.col("weight") < 0, "a weight is negative"),
    ]
    return merged.select("t", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))).alias("error"))


def chain_text(s: dict) -> str:
    """A texture's chain settings in words."""
    return " ".join([s.get("filter", "default"), *(n for n in ("srgb", "normal_map") if s.get(n)), *(["wrap"] if s.get("edge") == "wrap" else [])])


def layout_text(c0: int) -> str:
    return {1: "one channel in one file", 2: "two channels in one file", 3: "three channels in two files", 4: "four channels in two files"}[c0]


def uniform(cw: Sequence[float]) -> bool:
    return min(cw) == max(cw)


def options_from(values: dict) -> Options:
    """Options from a flat mapping; unknown names are errors."""
    known = {f.name for f in fields(Options)}
    unknown = set(values) - known
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})



def _flag(name: str) -> str:
    return "--" + name.replace("_", "-")


def parse_options(argv: Sequence[str]) -> tuple[Options, list[str], dict[str, str]]:
    """Options, inputs and what else was asked (out, name, tiles, png, quiet) from a command line; ValueError says what is wrong.

    Every option of ``Options`` is a flag of its name; lists are commas between numbers, colour weights triples in a row.
    """
    given: dict[str, object] = {}
    other: dict[str, str] = {}
    inputs: list[str] = []
    known = {_flag(f.name): f for f in fields(Options)}
    defaults = Options()
    words = list(argv)
    while words:
        word = words.pop(0)
        if word in ("--tiles", "--png", "--quiet"):
            other[word[2:]] = "yes"
        elif word in ("-o", "--out", "--name") or word in known:
            if not words:
                raise ValueError(f"{word} needs a value")
            text = words.pop(0)
            if word not in known:
                other["out" if word == "-o" else word[2:]] = text
                continue
            name, now = known[word].name, getattr(defaults, known[word].name)
            try:
                if isinstance(now, bool):
                    given[name] = {"0": False, "1": True}[text]
                elif isinstance(now, (int, float)):
                    given[name] = type(now)(text)
                elif isinstance(now, str):
                    given[name] = text
                else:
                    numbers = tuple((int if name == "bits0" else float)(x) for x in text.split(","))
                    if name == "rgb_weights":
                        if len(numbers) % 3:
                            raise ValueError
                        numbers = tuple(numbers[i : i + 3] for i in range(0, len(numbers), 3))
                    given[name] = numbers
            except (ValueError, KeyError) as e:
                raise ValueError(f"{text!r} is no value of {word}") from e
        elif word.startswith("-"):
            raise ValueError(f"unknown option {word}")
        else:
            inputs.append(word)
    if not inputs:
        raise ValueError("no pictures and no material are given")
    return Options(**given), inputs, other


def same_file(a: str, b: str) -> bool:
    """Whether two paths are one: separators, dots and letters' case aside where the system takes them for equal."""
    import os

    plain = lambda p: os.path.normcase(os.path.abspath(p.removeprefix("file:")))
    return plain(a) == plain(b)


def banner(o: Options, textures: int, width: int, height: int) -> str:
    """What is about to be fitted, in a few lines."""
    layout = layout_text(o.c0) if o.l0 == "bc8" else f"palettes of {', '.join(map(str, o.palette_bits))} bits"
    changed = [f"{_flag(f.name)} {getattr(o, f.name)}" for f in fields(Options) if getattr(o, f.name) != f.default]
    lines = [f"{textures} texture{'s' * (textures > 1)} of {width} x {height}", f"level 0: {layout}; level 1: {o.c1} channels of {o.bits1} bits, a quarter a side", f"{o.rounds} rounds{' with mips' if o.mips else ''}"]
    return "\n".join([*lines, *(["options: " + " ".join(changed)] if changed else [])])
