"""Document-to-order reconciliation and event analytics as Spark jobs."""
