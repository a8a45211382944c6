"""Small per-value Python helpers run as Arrow-batched pandas UDFs.

Kept in a module without postponed annotations: pandas UDF type hints must be
real types.
"""

import html

import pandas as pd
from pyspark.sql import functions as F

_CACHE = {}


def unescape_udf():
    if "unescape" not in _CACHE:
        @F.pandas_udf("string")
        def _unescape(s: pd.Series) -> pd.Series:
            return s.map(lambda v: None if v is None else html.unescape(v))
        _CACHE["unescape"] = _unescape
    return _CACHE["unescape"]
