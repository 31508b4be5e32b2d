"""Decoders of the less common picture formats: TGA, PSD, Radiance HDR, Softimage PIC and binary PNM.

Each takes a file's bytes and gives (h, w, channels) bytes: grey, grey and alpha, RGB or RGBA. A file
that is cut short or of a kind that isn't read raises a ``ValueError``.
"""

from __future__ import annotations

import re
import struct

import numpy as np

_PIC = b"\x53\x80\xf6\x34"
_HDR = re.compile(rb"#\?(?:RADIANCE|RGBE)\n(?:[^\n]+\n)*?\n-Y +(\d+) +\+X +(\d+)[^\n]*\n")
_PNM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
HDR_GAMMA = 2.2  # fixed value: how linear light becomes bytes


def _tga_header(data: bytes) -> tuple[int, ...] | None:
    """The fields of a TGA header; the format has no magic number, so they must make sense together."""
    if len(data) < 18:
        return None
    own, mapped, kind, first, colours, colour_bits, _, _, w, h, bits, flags = struct.unpack("<BBBHHBHHHHBB", data[:18])
    deep = {1: (8, 16), 2: (15, 16, 24, 32), 3: (8, 16)}.get(kind & 7, ())
    if kind not in (1, 2, 3, 9, 10, 11) or mapped != (kind & 7 == 1) or bits not in deep or not w or not h:
        return None
    if mapped and colour_bits not in (8, 15, 16, 24, 32):
        return None
    return own, kind, first, colours, colour_bits, w, h, bits, flags


def dimensions(head: bytes) -> tuple[int, int] | None:
    """Width and height from a file's first bytes."""
    if head[:4] == b"8BPS" and len(head) >= 22:
        h, w = struct.unpack(">II", head[14:22])
        return w, h
    if head[:4] == _PIC and len(head) >= 96:
        return struct.unpack(">HH", head[92:96])
    if found := _PNM.match(head):
        return int(found[2]), int(found[3])
    if found := _HDR.match(head):
        return int(found[2]), int(found[1])
    tga = _tga_header(head)
    return tga and (tga[5], tga[6])


def _colours(raw: np.ndarray, bits: int, grey: bool = False) -> np.ndarray:
    """(n, channels) bytes of TGA pixels given as (n, bytes): blue comes first, 15 and 16 bits hold five a colour."""
    if bits == 8 or grey:
        return raw
    if bits in (15, 16):
        word = raw[:, 0].astype(np.int32) | raw[:, 1].astype(np.int32) << 8
        return np.stack([(word >> s & 31) * 255 // 31 for s in (10, 5, 0)], 1).astype(np.uint8)
    return np.concatenate([raw[:, 2::-1], raw[:, 3:]], 1)


def decode_tga(data: bytes) -> np.ndarray:
    """Mapped, true-colour and grey pictures, plain or in packets; rows from the top, columns from the left."""
    header = _tga_header(data)
    if header is None:
        raise ValueError("not a TGA")
    own, kind, first, colours, colour_bits, w, h, bits, flags = header
    at, unit, table = 18 + own, (bits + 7) // 8, None
    if kind & 7 == 1:
        wide = (colour_bits + 7) // 8
        table = _colours(np.frombuffer(data, np.uint8, colours * wide, at).reshape(colours, wide), colour_bits)
        at += colours * wide
    pixels = np.empty((w * h, unit), np.uint8)
    if kind < 8:
        pixels[:] = np.frombuffer(data, np.uint8, w * h * unit, at).reshape(-1, unit)
    else:
        done = 0
        while done < w * h:
            if at >= len(data):
                raise ValueError("a TGA that ends too soon")
            n, repeated = min((data[at] & 127) + 1, w * h - done), data[at] >> 7
            given = 1 if repeated else n
            pixels[done : done + n] = np.frombuffer(data, np.uint8, given * unit, at + 1).reshape(given, unit)
            at, done = at + 1 + given * unit, done + n
    if table is None:
        image = _colours(pixels, bits, kind & 7 == 3)
    else:
        index = pixels[:, 0].astype(np.int64) | (pixels[:, 1].astype(np.int64) << 8 if unit == 2 else 0)
        index -= first
        image = table[np.where((index < 0) | (index >= colours), 0, index)]
    image = image.reshape(h, w, -1)
    image = image if flags & 0x20 else image[::-1]
    return image[:, ::-1] if flags & 0x10 else image


def _packbits(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """``n`` bytes of PackBits runs and where they end."""
    out, done = np.empty(n, np.uint8), 0
    while done < n:
        if at >= len(data):
            raise ValueError("runs that end too soon")
        c, at = data[at], at + 1
        if c == 128:
            continue
        run, given = (257 - c, 1) if c > 128 else (c + 1, c + 1)
        if done + run > n:
            raise ValueError("a run beyond its picture")
        out[done : done + run] = np.frombuffer(data, np.uint8, given, at)
        at, done = at + given, done + run
    return out, at


def decode_psd(data: bytes) -> np.ndarray:
    """The merged picture of an RGB document of 8 or 16 bits, its white matte taken out where alpha is partial."""
    if data[:4] != b"8BPS" or len(data) < 26:
        raise ValueError("not a PSD")
    version, n, h, w, depth, mode = struct.unpack(">H6xHIIHH", data[4:26])
    if version != 1 or not 1 <= n <= 16 or depth not in (8, 16) or mode != 3:
        raise ValueError("not a flat RGB PSD of 8 or 16 bits")
    at = 26
    for _ in range(3):  # colour table, resources, layers
        at += 4 + struct.unpack(">I", data[at : at + 4])[0]
    packing, at, kept = struct.unpack(">H", data[at : at + 2])[0], at + 2, min(n, 4)
    image = np.zeros((kept, h * w), np.uint8)
    if packing == 1:
        if depth != 8:
            raise ValueError("packed 16-bit PSDs aren't read")
        at += 2 * h * n
        for c in range(kept):
            image[c], at = _packbits(data, at, h * w)
    elif packing == 0:
        wide = depth // 8
        image[:] = np.frombuffer(data, np.uint8, kept * h * w * wide, at).reshape(kept, h * w, wide)[:, :, 0]
    else:
        raise ValueError("a PSD of unknown packing")
    rgba = np.concatenate([image, np.zeros((max(0, 3 - kept), h * w), np.uint8), np.full((int(kept < 4), h * w), 255, np.uint8)]).T
    if kept == 4:
        part = (rgba[:, 3] > 0) & (rgba[:, 3] < 255)
        scale = 255.0 / rgba[part, 3:].astype(np.float64)
        rgba[part, :3] = np.clip(rgba[part, :3] * scale + 255 * (1 - scale), 0, 255).astype(np.uint8)
    return rgba.reshape(h, w, 4)


def _hdr_row(data: bytes, at: int, w: int) -> tuple[np.ndarray, int]:
    """One scan line of four byte planes in runs, as (w, 4), and where it ends."""
    out = np.empty((4, w), np.uint8)
    for plane in out:
        done = 0
        while done < w:
            if at >= len(data):
                raise ValueError("an HDR that ends too soon")
            c = data[at]
            run, given = (c - 128, 1) if c > 128 else (c, c)
            if run == 0 or done + run > w:
                raise ValueError("a run beyond its line")
            plane[done : done + run] = np.frombuffer(data, np.uint8, given, at + 1)
            at, done = at + 1 + given, done + run
    return out.T, at


def decode_hdr(data: bytes) -> np.ndarray:
    """Shared-exponent radiance as bytes, x to the power of 1 / ``HDR_GAMMA``."""
    found = _HDR.match(data)
    if not found or b"\nFORMAT=32-bit_rle_rgbe\n" not in found[0]:
        raise ValueError("not an RGBE picture, top row first")
    h, w, at = int(found[1]), int(found[2]), found.end()
    if 8 <= w < 32768 and data[at : at + 2] == b"\x02\x02" and data[at + 2] < 128:
        rows = []
        for _ in range(h):
            if data[at : at + 4] != struct.pack(">BBH", 2, 2, w):
                raise ValueError("a scan line of another width")
            row, at = _hdr_row(data, at + 4, w)
            rows.append(row)
        rgbe = np.stack(rows)
    else:
        rgbe = np.frombuffer(data, np.uint8, h * w * 4, at).reshape(h, w, 4)
    light = np.ldexp(rgbe[..., :3].astype(np.float64), rgbe[..., 3:].astype(np.int32) - 136) * (rgbe[..., 3:] > 0)
    return np.clip(light ** (1 / HDR_GAMMA) * 255 + 0.5, 0, 255).astype(np.uint8)


def decode_pic(data: bytes) -> np.ndarray:
    """A Softimage picture: every line holds a part for each group of channels, plain or in one of two kinds of runs."""
    if data[:4] != _PIC or data[88:92] != b"PICT" or len(data) < 104:
        raise ValueError("not a PIC")
    w, h = struct.unpack(">HH", data[92:96])
    at, groups, more = 104, [], 1
    while more:
        more, size, packing, mask = data[at : at + 4]
        at += 4
        if size != 8 or packing > 2:
            raise ValueError("a PIC of unknown packing")
        groups.append((packing, [c for c, bit in enumerate((0x80, 0x40, 0x20, 0x10)) if mask & bit]))
    image = np.full((h, w, 4), 255, np.uint8)
    for line in image:
        for packing, own in groups:
            unit, done = len(own), 0
            while done < w:
                if packing == 0:
                    run, given = w, w
                elif packing == 1:
                    run, given, at = data[at], 1, at + 1
                elif data[at] < 128:
                    run, at = data[at] + 1, at + 1
                    given = run
                elif data[at] == 128:
                    run, given, at = struct.unpack(">H", data[at + 1 : at + 3])[0], 1, at + 3
                else:
                    run, given, at = data[at] - 127, 1, at + 1
                if run == 0 or done + run > w:
                    raise ValueError("a run beyond its line")
                line[done : done + run, own] = np.frombuffer(data, np.uint8, given * unit, at).reshape(given, unit)
                at, done = at + given * unit, done + run
    return image if any(3 in own for _, own in groups) else image[..., :3]


def decode_pnm(data: bytes) -> np.ndarray:
    """Binary grey and colour maps; bytes as they stand, of two-byte samples the upper one."""
    found = _PNM.match(data)
    if not found or not 1 <= int(found[4]) <= 65535:
        raise ValueError("not a binary PGM or PPM")
    w, h, per, wide = int(found[2]), int(found[3]), 3 if found[1] == b"6" else 1, 1 + (int(found[4]) > 255)
    return np.frombuffer(data, np.uint8, h * w * per * wide, found.end()).reshape(h, w, per, wide)[..., 0]


def decode(data: bytes) -> np.ndarray:
    """A picture of any of these formats, told apart by its first bytes; what none of them claims must be a TGA."""
    for start, read in ((b"8BPS", decode_psd), (_PIC, decode_pic), (b"#?", decode_hdr), (b"P5", decode_pnm), (b"P6", decode_pnm)):
        if data.startswith(start):
            return read(data)
    return decode_tga(data)
