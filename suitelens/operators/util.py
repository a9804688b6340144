"""Small planning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it is proven small: at most this many rows and bytes.
BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                    max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` if a bounded check shows at most ``max_rows`` rows and about
    ``max_bytes`` bytes (JSON size of the rows); otherwise leave the join strategy
    to Spark (sort-merge, with AQE's runtime broadcast and skew split).

    The check reads at most ``max_rows + 1`` rows, so it stays cheap for big inputs.
    """
    probe = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))),
                   F.lit(0)).alias("b")).first()
    small = probe["n"] <= max_rows and probe["b"] <= max_bytes
    return F.broadcast(df) if small else df
