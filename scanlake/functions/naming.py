"""File names, magnification text and recognised digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are read as digits.
DIGIT_LOOKALIKES = {
    "q": "9", "g": "9",
    "o": "0", "O": "0", "Q": "0", "D": "0",
    "l": "1", "I": "1", "i": "1", "|": "1",
    "s": "5", "S": "5",
    "b": "6", "B": "8", "Z": "2", "z": "2",
}
_NUMBER = r"([+-][0-9.]+)"


def build_filename(
    sample: Column,
    ts: Column | None = None,
    mag: Column | None = None,
    exposure_ms: Column | None = None,
    x: Column | None = None,
    y: Column | None = None,
    ext: str = "png",
) -> Column:
    """Name of a saved image. Parts left out or null are skipped; x and y only appear together."""
    parts = [F.coalesce(F.nullif(F.trim(sample), F.lit("")), F.lit("capture"))]
    if ts is not None:
        parts.append(F.date_format(ts, "yyyyMMdd_HHmmss"))
    if mag is not None:
        parts.append(F.replace(mag, F.lit("/"), F.lit("-")))
    if exposure_ms is not None:
        whole = F.rint(exposure_ms).cast("long").cast("string")
        parts.append(F.concat(whole, F.lit("ms")))
    if x is not None and y is not None:
        both = x.isNotNull() & y.isNotNull()
        parts.append(F.when(both, F.format_string("X%+.3f_Y%+.3f", x, y)))
    return F.concat(F.concat_ws("_", *parts), F.lit(f".{ext}"))


def tile_filename(x: Column, y: Column) -> Column:
    """Name of one image of a wafer scan."""
    return F.format_string("img_X%+.3f_Y%+.3f.png", x, y)


def parse_filename(name: Column) -> tuple[Column, Column]:
    """Stage x and y out of a file name or path, null where the name carries none."""
    pattern = rf"X{_NUMBER}_Y{_NUMBER}\.[A-Za-z]+"
    return _number(F.regexp_extract(name, pattern, 1)), _number(F.regexp_extract(name, pattern, 2))


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def parse_mag(text: Column) -> Column:
    """Number in front of a trailing x; 0 when there is none."""
    return F.coalesce(F.regexp_replace(text, "[xX ]+$", "").try_cast("double"), F.lit(0.0))


def normalise_digits(text: Column) -> Column:
    """First digit of a recognised text after look-alike letters are replaced, else null."""
    mapped = F.translate(F.replace(text, F.lit(" "), F.lit("")), "".join(DIGIT_LOOKALIKES), "".join(DIGIT_LOOKALIKES.values()))
    return F.nullif(F.regexp_extract(mapped, "[0-9]", 0), F.lit(""))


def grid_label(tl: Column, tr: Column, bl: Column, br: Column) -> tuple[Column, Column]:
    """Grid coordinates from the four digits of a mark, null unless all four were read."""
    whole = tl.isNotNull() & tr.isNotNull() & bl.isNotNull() & br.isNotNull()
    return F.when(whole, F.concat(tl, tr).cast("int")), F.when(whole, F.concat(bl, br).cast("int"))
