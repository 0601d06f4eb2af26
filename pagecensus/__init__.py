"""Page audit on Spark: facts, findings, patterns and reports over tables of page snapshots."""
