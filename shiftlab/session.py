"""Session settings the analyses are planned for."""

from __future__ import annotations

SETTINGS = {
    # Partitions are merged and split by their real sizes, hot join keys are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # ISO dates and yyyyMMdd integers mean UTC days.
    "spark.sql.session.timeZone": "UTC",
    # Python call sites are not recorded for every column built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder, shuffle_partitions: int | None = None):
    """Apply the settings to a session builder.

    On a cluster give ``shuffle_partitions`` a generous upper bound (adaptive execution merges
    what it does not need) and set ``spark.checkpoint.dir`` to a shared folder.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder
