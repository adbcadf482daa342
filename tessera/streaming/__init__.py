"""Structured Streaming faces of the batch operators.

Z1 ``ingest``     file stream -> in-stream dedup -> insert-only merge into silver (foreachBatch)
Z2 ``activity``   tumbling local-day / hour windows per traffic class (append mode, watermark)
Z3 ``inactivity_sessions``, ``room_expiries``   silences per player and per private room with ``session_window``
Z4 ``hold_outcomes``  grab -> next move event per socket within the hold timeout, from overlapping windows

Z2-Z4 take a stream or a stored table; on a stored table they give what the stream gives once its watermark has passed.
The batch rebuild stays the source of truth: events later than the watermark are dropped by Z2/Z3 (Spark
reports them as ``numRowsDroppedByWatermark``) and picked up by the next batch run.
"""
