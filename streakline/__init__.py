"""streakline: event-log analytics for ordered per-entity records, on PySpark."""
