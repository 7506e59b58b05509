"""SHA-256 identities over length-prefixed fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "tallymill.event.v1"
COUNTS = ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens")


def _big(x: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 2 * size, "0"))


def _text(name: str) -> Column:
    raw = F.encode(F.col(name), "UTF-8")
    return F.concat(_big(F.octet_length(raw), 4), raw)


def _count(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), _big(F.col(name), 8)))


def fingerprint(ordinal: str = "source_offset") -> Column:
    """Identity of a usage event: who, which session, the ordinal there, the model and the five counts."""
    return F.sha2(F.concat(F.encode(F.lit(TAG), "UTF-8"), _text("provider_id"), _text("profile_id"), _text("session_id"), _big(F.col(ordinal), 8), _text("model"), *map(_count, COUNTS)), 256)


def replay_signature(cumulative: str) -> Column:
    """Identity of what an event says whatever its session: the model, the counts, and the cumulative counts (a struct) if known."""
    whole = F.concat(F.unhex(F.lit("01")), *[_count(f"{cumulative}.{c}") for c in COUNTS])
    known = F.when(F.col(cumulative).isNull(), F.unhex(F.lit("00"))).otherwise(whole)
    return F.sha2(F.concat(F.encode(F.lit(TAG + ".replay"), "UTF-8"), _text("model"), *map(_count, COUNTS), known), 256)


def event_id(fp: Column) -> Column:
    return F.concat(F.lit("event_"), F.substring(fp, 1, 20))
