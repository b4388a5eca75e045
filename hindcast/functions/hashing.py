"""Canonical row text and hashes.

A row's canonical text is compact JSON with fields in name order and nulls
kept. It is this package's own contract: number text follows the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def row_fingerprint(columns: list[str], **fixed: str) -> Column:
    """SHA-256 of the row; ``fixed`` adds version strings to the hashed input."""
    constants = {name: F.lit(value).alias(name) for name, value in fixed.items()}
    fields = [constants.get(name, F.col(name) if name not in constants else None) for name in sorted([*columns, *constants])]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
