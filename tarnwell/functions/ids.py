"""Names and hashes that are the same in every run."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def stable_hash(value, size: int = 64) -> str:
    """Hex digits of a value's JSON, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:size]


def short_id(value, size: int = 8) -> str:
    return stable_hash(value, size)


def dataset_slug(*parts: str) -> str:
    return slugify("-".join(parts)) or "dataset"


def row_hash(*cols: Column, size: int = 64) -> Column:
    """Hex digits of a row's values as text, null apart from empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in cols])
    return F.substring(F.sha2(text, 256), 1, size)
