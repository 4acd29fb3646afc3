"""Deterministic identities."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def joined(*parts: Column, sep: str = "_") -> Column:
    """Parts as one string; a missing part is the empty string."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def hashed_id(*parts: Column, digits: int = 24, prefix: str = "") -> Column:
    """The first hex digits of the MD5 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.md5(joined(*parts)), 1, digits))


def input_hash(text: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


@F.pandas_udf(T.StringType())
def blake2b_96(text: pd.Series) -> pd.Series:
    """Hex BLAKE2b of 96 bits, which Spark has no expression for; null stays null."""
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=12).hexdigest())


def source_event_id(kind: Column, stamp: Column, code: Column, name: Column, note: Column, procedure: Column, image: Column, visit: Column) -> Column:
    """The id of a source event: its own number where its kind has one, else a hash of time, kind and code or name."""
    own = lambda prefix, x: F.concat(F.lit(prefix), x)
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    by_code = kind.isin("condition", "drug_exposure")
    rest = hashed_id(stamp, kind, F.when(by_code, code).otherwise(name))
    return (
        F.when((kind == "note") & has(note), own("note_", note))
        .when((kind == "procedure") & has(procedure), own("proc_", procedure))
        .when((kind == "image") & has(image), own("img_", image))
        .when(kind.isin("visit", "visit_detail") & has(visit), own("visit_", visit))
        .otherwise(rest)
    )
