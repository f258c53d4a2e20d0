"""Indoor positioning telemetry as Spark jobs: ranges, fixes, floors, zones, calibration, evaluation."""
