"""Bytes of a response to text: byte-order marks, declared and sniffed charsets."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.udfs import arrow_udf

_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_DECLARED = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
_HEADER = re.compile(r"""charset\s*=\s*["']?([^\s;"']+)""", re.IGNORECASE)
_PRINTABLE = bytes(range(0x20, 0x7F))
SNIFFED_BYTES = 2048


def known_codec(name: str | None) -> str | None:
    """The codec's own name; None if there is no such text codec."""
    try:
        found = codecs.lookup(name or "")
    except (LookupError, ValueError):
        return None
    return found.name if getattr(found, "_is_text_encoding", True) else None


def ascii_compatible(codec: str) -> bool:
    try:
        return _PRINTABLE.decode(codec) == _PRINTABLE.decode("ascii")
    except (UnicodeError, LookupError):
        return False


def charset_of(content_type: str | None, body: bytes) -> str:
    """The header's charset if known, else the markup's if it can be (ASCII has to read as ASCII), else UTF-8."""
    header = _HEADER.search(content_type or "")
    if header and (codec := known_codec(header[1])):
        return codec
    meta = _DECLARED.search(body[:SNIFFED_BYTES])
    codec = known_codec(meta[1].decode("ascii")) if meta else None
    return codec if codec and ascii_compatible(codec) else "utf-8"


def decode_body(content_type: str | None, body: bytes | None) -> str | None:
    """Text of a body; a byte-order mark wins, what can't be decoded is replaced."""
    if body is None:
        return None
    for mark, codec in _MARKS:
        if body.startswith(mark):
            return body.decode(codec if codec != "utf-8" else "utf-8-sig", "replace")
    return body.decode(charset_of(content_type, body), "replace")


@arrow_udf("string")
def _decoded(types: pd.Series, bodies: pd.Series) -> pd.Series:
    return pd.Series([decode_body(t, b) for t, b in zip(types, bodies, strict=True)], dtype="object")


def decoded(content_type: Column, body: Column) -> Column:
    return _decoded(content_type, body)
