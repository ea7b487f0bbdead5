"""Knowledge, lineage and robustness analytics as Spark DataFrame operators."""
