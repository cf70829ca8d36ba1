"""fixturelake: reconciliation of successive snapshots of human-edited schedules on Spark."""
