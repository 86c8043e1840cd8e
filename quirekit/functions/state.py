"""Maps, canonical JSON and the progress header (MAP-01, JSN-01, JSN-02)."""

from __future__ import annotations

import base64
import json
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirekit.functions import fixed

HEADER_PREFIX = "[[PROGRESS_STATE::"
HEADER_SUFFIX = "]]\n"


def overlay(*maps: Column) -> Column:
    """MAP-01: later maps win, whatever the session's duplicate-key policy is."""
    merged = maps[0]
    for over in maps[1:]:
        kept = F.map_filter(merged, lambda key, _value: ~F.array_contains(F.map_keys(over), key))
        merged = F.map_concat(kept, over)
    return merged


def canonical_json(values: Column) -> Column:
    """JSN-01: a map as JSON with sorted keys and no blanks."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(values))))


@F.pandas_udf(StringType())
def progress_header(payload: pd.Series) -> pd.Series:
    """JSN-02: JSON state, deflated and base64-coded, padded to a header of fixed size."""
    room = fixed.PROGRESS_HEADER_BYTES - len(HEADER_PREFIX) - len(HEADER_SUFFIX)

    def encode(text):
        if text is None:
            return None
        packed = base64.b64encode(zlib.compress(text.encode())).decode()
        if len(packed) > room:
            raise ValueError("progress state does not fit its header")
        return HEADER_PREFIX + packed.ljust(room) + HEADER_SUFFIX

    return payload.map(encode)


@F.pandas_udf(StringType())
def progress_payload(header: pd.Series) -> pd.Series:
    """JSN-02: JSON state of a header, null when it is none."""

    def decode(text):
        if not text or not (text.startswith(HEADER_PREFIX) and text.endswith(HEADER_SUFFIX)):
            return None
        try:
            packed = text[len(HEADER_PREFIX):-len(HEADER_SUFFIX)].rstrip()
            return json.dumps(json.loads(zlib.decompress(base64.b64decode(packed))), separators=(",", ":"))
        except (ValueError, zlib.error):
            return None

    return header.map(decode)
