"""History analytics over daily snapshots, on Spark."""
