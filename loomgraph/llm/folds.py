"""The split into documents that a model may learn from and those held out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; a null doc_id is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))
