"""tessera: gameplay-event analytics on Spark.

Layers:
  functions/  column expressions (JSON fields, local calendar, traffic class, ratios, labels)
  operators/  generic DataFrame operators (dedup, next-event pairing, interval stats, spines, ranks)
  sources/    driver-table adapter, versioned Parquet lake, JDBC source
  plans/      silver, gold, serving and quality tables built from the operators
  streaming/  Structured Streaming faces of the same operators
"""

from tessera.session import build_session, ensure_utc

__all__ = ["build_session", "ensure_utc"]
