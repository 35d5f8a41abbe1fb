"""Counts and rates that come with a job's own pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(packets: DataFrame, name: str = "packets") -> tuple[DataFrame, Observation]:
    """The packets, and an observation of packets, bytes and failed files once an action has run."""
    seen = Observation(name)
    out = packets.observe(
        seen,
        F.count("data").alias("packets"),
        F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"),
        F.count("error").alias("failed_files"),
    )
    return out, seen


def rates(seen: Observation, seconds: float) -> dict[str, float]:
    """Packets and bytes a second."""
    got = seen.get
    return {f"{k}_per_second": got[k] / seconds if seconds else 0.0 for k in ("packets", "bytes")}
