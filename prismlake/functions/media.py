"""Scalar functions of the media index, all as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from prismlake.functions.text import trim_unicode

# File name extensions by kind.
IMAGE = ["jpg", "jpeg", "png", "bmp", "tif", "tiff"]
RAW = ["cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf", "pef", "srw"]
HEIC = ["heic", "heif"]
VIDEO = ["mp4", "mov", "avi", "m4v", "mkv"]


def extension(file: Column) -> Column:
    """Lowered text behind the last dot of the file's own name; empty for dot files and names without one."""
    return F.lower(F.regexp_extract(file, r"[^/]\.([^./]*)$", 1))


def is_supported(file: Column) -> Column:
    return extension(file).isin(IMAGE + RAW + HEIC + VIDEO)


def media_kind(file: Column) -> Column:
    """video, raw, heic, else image."""
    ext = extension(file)
    return F.when(ext.isin(VIDEO), "video").when(ext.isin(RAW), "raw").when(ext.isin(HEIC), "heic").otherwise("image")


def path_key(file: Column) -> Column:
    """Sorts paths by their components rather than by bytes."""
    return F.split(file, "/")


def excluded_names(text: Column) -> Column:
    """Names of a comma list: trimmed, lowered, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def in_excluded(file: Column, names: Column) -> Column:
    """True if a directory on the way to the file has one of the names, in any case."""
    parts = path_key(file)
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: F.array_contains(names, F.lower(d)))


def relative_path(file: Column, folder: str) -> Column:
    prefix = folder.rstrip("/") + "/"
    return F.when(F.startswith(file, F.lit(prefix)), F.substr(file, F.lit(len(prefix) + 1))).otherwise(file)


def year_month(date: Column) -> Column:
    """YYYY-MM of texts that begin with four digits, - or :, and two digits; else null. Months aren't checked."""
    return F.when(date.rlike("^[0-9]{4}[-:][0-9]{2}"), F.concat(F.substr(date, F.lit(1), F.lit(4)), F.lit("-"), F.substr(date, F.lit(6), F.lit(2))))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "landscape").when(height > width, "portrait").when(width == height, "square")


def resolution(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def clean(text: Column) -> Column:
    """Without quotes at both ends, and then without white space there."""
    return trim_unicode(F.regexp_replace(text, '^"+|"+$', ""))


def camera(make: Column, model: Column) -> Column:
    return trim_unicode(F.concat_ws(" ", F.coalesce(clean(make), F.lit("")), F.coalesce(clean(model), F.lit(""))))


def degrees(d: Column, m: Column, s: Column, ref: Column, negative: str) -> Column:
    """Decimal degrees; negative if the reference text starts with ``negative``; a missing one is positive."""
    value = d + m / 60.0 + s / 3600.0
    return F.when(F.startswith(ref, F.lit(negative)), -value).otherwise(value)


def flash(tag: Column) -> Column:
    """yes or no by the lowest bit; empty if there's no tag."""
    return F.when(tag.isNull(), "").when(tag.bitwiseAND(1) == 1, "yes").otherwise("no")


def screenshot(kind: Column, make: Column, model: Column) -> Column:
    """yes for anything but video without make and model."""
    blank = (F.coalesce(make, F.lit("")) == "") & (F.coalesce(model, F.lit("")) == "")
    return F.when(blank & (kind != "video"), "yes").otherwise("")


def geo_cell(degrees_: Column) -> Column:
    """Hundredths of a degree, halves away from zero; null for null, NaN and infinity."""
    return F.when(~F.isnan(degrees_) & (F.abs(degrees_) < 1e6), F.round(degrees_ * 100).cast("long"))


def hash_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fixed_text(x: Column, places: int) -> Column:
    """The exact binary value rounded to so many places, halves to even; null stays null."""
    return F.regexp_replace(F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * places)), ",", "")


def zero_blank(n: Column) -> Column:
    return F.coalesce(F.nullif(n.cast("string"), F.lit("0")), F.lit(""))


def list_text(names: Column) -> Column:
    return F.array_join(names, ", ")


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))
