"""Text identity: decoding, markup removal, normalisation, hashing."""

from __future__ import annotations

import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a blank: Unicode blanks and the four separators that Java's class leaves out.
BLANK = r"(?U)[\s\x{1c}-\x{1f}\x{85}\x{a0}]+"
SEEN = BLANK.replace("[", "[^").removesuffix("+")
ENCODINGS = ("utf-8", "utf-16", "cp949", "latin-1")


def collapse(text: Column) -> Column:
    """Runs of blanks become one space, ends are trimmed, case stays; null if nothing is left."""
    return F.when(seen(text), spaced(text))


def seen(text: Column) -> Column:
    """Whether anything but blanks is there; unlike a test of the collapsed text, this ends at the first character."""
    return text.rlike(SEEN)


def spaced(text: Column) -> Column:
    """``collapse`` where something is left."""
    return F.btrim(F.regexp_replace(text, BLANK, " "), F.lit(" "))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def normalize(text: Column) -> Column:
    """Entities resolved, then collapsed. Texts without '&' never reach Python if the caller routes them by it."""
    return collapse(unescape(text))


def strip_markup(text: Column) -> Column:
    """Tags become blanks."""
    return F.regexp_replace(text, r"<[^>]+>", " ")


def text_hash(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


def decode_bytes(data: bytes | None) -> str | None:
    """The first encoding in order that reads all bytes."""
    if data is None:
        return None
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def _members(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    return [archive.read(n).decode("utf-8", "ignore") for n in sorted(archive.namelist()) if re.fullmatch(pattern, n)]


def _tagged(parts: list[str], tag: str) -> str:
    return " ".join(x for part in parts for x in re.findall(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", part, re.S))


def office_text(data: bytes, ext: str) -> str | None:
    """Text of a zipped office document, or None if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            if ext == ".docx":
                return _tagged(_members(archive, r"word/.*\.xml"), "w:t")
            if ext == ".pptx":
                return _tagged(_members(archive, r"ppt/slides/slide[^/]*\.xml"), "a:t")
            if ext == ".xlsx":
                return " ".join((_tagged(_members(archive, r"xl/sharedStrings\.xml"), "t"), _tagged(_members(archive, r"xl/worksheets/sheet[^/]*\.xml"), "v"))).strip()
            pattern = r"Contents/section.*\.xml" if ext == ".hwpx" else r"content\.xml"
            return re.sub(r"<[^>]+>", " ", " ".join(_members(archive, pattern)))
    except (zipfile.BadZipFile, KeyError, OSError, ValueError):
        return None


def optional_text(data: bytes, ext: str) -> str | None:
    """PDF and HWP text, where their readers are installed."""
    try:
        if ext == ".pdf":
            from pypdf import PdfReader

            return " ".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
        import olefile

        with olefile.OleFileIO(io.BytesIO(data)) as ole:
            return ole.openstream("PrvText").read().decode("utf-16-le", "ignore")
    except Exception:  # readers raise many kinds; an unreadable file has no text
        return None


@F.pandas_udf(T.StringType())
def extract_text(data: pd.Series, ext: pd.Series) -> pd.Series:
    """Text of a file by its extension; null where it has none or cannot be read."""
    from ..functions import fixed

    def one(raw, kind):
        if raw is None:
            return None
        if kind in fixed.DOCZIP_EXTS:
            return office_text(raw, kind)
        if kind in fixed.PDF_EXTS + fixed.HWP_EXTS:
            return optional_text(raw, kind)
        return decode_bytes(raw) if kind in fixed.PLAINTEXT_EXTS else None

    return pd.Series([one(d, e) for d, e in zip(data, ext, strict=True)], dtype=object)


def with_ocr_fallback(text: Column, ext: Column, ocr: Column) -> Column:
    """A PDF with fewer than 20 characters, or an image, takes the text that a given OCR column has."""
    from ..functions import fixed

    poor = (ext.isin(*fixed.PDF_EXTS) & (F.char_length(F.coalesce(text, F.lit(""))) < 20)) | ext.isin(*fixed.IMAGE_EXTS, *fixed.RAW_EXTS)
    return F.when(poor, F.coalesce(ocr, text)).otherwise(text)
