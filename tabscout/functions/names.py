"""Name normalisation."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def table_key(name: Column) -> Column:
    """Trimmed, comma-free, lower case, blanks as underscores, one leading underscore at least."""
    plain = F.lower(F.replace(F.replace(F.trim(name), F.lit(","), F.lit("")), F.lit(" "), F.lit("_")))
    return F.when(plain.startswith("_"), plain).otherwise(F.concat(F.lit("_"), plain))


def fk_key(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def collection_name(db: Column, table_id: Column) -> Column:
    return F.translate(F.concat_ws("_", db, table_id), "-.", "__")


def utf8(raw: Column) -> Column:
    """Bytes to text, malformed sequences replaced."""
    return F.make_valid_utf8(raw.cast("string"))
