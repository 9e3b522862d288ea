"""Record keys: a reversible text of a key tuple, ``bytes:value`` for each part."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ModelError


def key_text(c: Column, kind: T.DataType | None = None) -> Column:
    """The canonical text of a key value: timestamps to the microsecond (zoned ones in UTC with ``Z``), all else as cast."""
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.TimestampType):
        return F.concat(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return c.cast("string")


def record_key(df: DataFrame, *names: str) -> Column:
    """The record key of ``names``; null if any part is."""
    parts = []
    for n in names:
        text = key_text(F.col(n), df.schema[n].dataType)
        parts += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.concat(*parts)


def decode_key(key: str) -> list[str]:
    """The values of a record key."""
    raw, out, at = key.encode(), [], 0
    while at < len(raw):
        colon = raw.find(b":", at)
        if colon < 0 or not raw[at:colon].isdigit():
            raise ModelError("record.key.invalid", key)
        end = colon + 1 + int(raw[at:colon])
        if end > len(raw):
            raise ModelError("record.key.invalid", key)
        out.append(raw[colon + 1 : end].decode())
        at = end
    return out


def encode_cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "k": values}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> list:
    try:
        data = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if data["v"] != 1 or not isinstance(data["k"], list):
            raise ValueError
        return data["k"]
    except (ValueError, KeyError, TypeError):
        raise ModelError("http.param.invalid", "cursor") from None
