"""Capture metadata of JPEG, TIFF, PNG and HEIF files."""

from __future__ import annotations

import struct

# Tag numbers.
MAKE, MODEL, ORIENTATION, DATE, EXIF_IFD, GPS_IFD, ORIGINAL, DIGITIZED, FLASH = 271, 272, 274, 306, 34665, 34853, 36867, 36868, 37385
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes) -> bytes | None:
    """The TIFF part: the whole of a TIFF file, a JPEG file's Exif segment, a PNG file's chunk, a HEIF file's item."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data) and data[at + 4 : at + 8] != b"eXIf":
            at += 12 + int.from_bytes(data[at : at + 4], "big")
        return data[at + 8 : at + 8 + int.from_bytes(data[at : at + 4], "big")] or None
    if data[4:8] == b"ftyp":
        at = data.find(b"Exif\0\0")
        while at >= 0 and data[at + 6 : at + 10] not in (b"II*\0", b"MM\0*"):
            at = data.find(b"Exif\0\0", at + 1)
        return data[at + 6 :] if at >= 0 else None
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _entries(data: bytes, at: int, order: str) -> dict[int, object]:
    """Values of a directory's tags: texts, numbers, or lists of (numerator, denominator)."""
    out = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size, place = _SIZE.get(kind, 0) * n, at + 2 + 12 * k + 8
        if not size or size > len(data):
            continue
        if size > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        raw = data[place : place + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (5, 10):
            out[tag] = [struct.unpack_from(order + ("II" if kind == 5 else "ii"), raw, 8 * i) for i in range(n)]
        elif kind in (3, 4):
            out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), raw)[0]
    return out


def _degrees(parts: object, ref: object, negative: str) -> float | None:
    if not isinstance(parts, list) or len(parts) != 3 or any(not d for _, d in parts):
        return None
    d, m, s = (a / b for a, b in parts)
    value = d + m / 60 + s / 3600
    return -value if str(ref or "").startswith(negative) else value


def _plain(text: object) -> str | None:
    return text.strip('"').strip() if isinstance(text, str) else None


def read_exif(data: bytes) -> dict[str, object]:
    """datetime, gps_lat, gps_lon, camera_make, camera_model, flash, orientation; None, and 1 for the last, where absent or damaged."""
    out = dict.fromkeys(("datetime", "gps_lat", "gps_lon", "camera_make", "camera_model", "flash")) | {"orientation": 1}
    try:
        tiff = _tiff(data)
        if tiff is None:
            return out
        order = "<" if tiff[:2] == b"II" else ">"
        top = _entries(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
        more = _entries(tiff, top[EXIF_IFD], order) if isinstance(top.get(EXIF_IFD), int) else {}
        gps = _entries(tiff, top[GPS_IFD], order) if isinstance(top.get(GPS_IFD), int) else {}
    except (struct.error, IndexError):
        return out
    flash, turn = more.get(FLASH), top.get(ORIENTATION)
    return {
        "datetime": next((_plain(x) for x in (more.get(ORIGINAL), top.get(DATE), more.get(DIGITIZED)) if x), None), "gps_lat": _degrees(gps.get(2), gps.get(1), "S"), "gps_lon": _degrees(gps.get(4), gps.get(3), "W"),
        "camera_make": _plain(top.get(MAKE)), "camera_model": _plain(top.get(MODEL)), "flash": flash if isinstance(flash, int) else None, "orientation": turn if turn in range(1, 9) else 1,
    }
