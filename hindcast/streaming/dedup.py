"""ST8: incremental de-duplication of replayed events.

``dropDuplicatesWithinWatermark`` keeps the *first* delivery of an event id
seen within the watermark delay (state is dropped after it), while the batch
model W1 keeps the *last*; for true replays (equal payloads) the two agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def dedupe_stream(events: DataFrame, event_time: str = "timestamp", delay: str = "2 hours") -> DataFrame:
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["event_id"])
