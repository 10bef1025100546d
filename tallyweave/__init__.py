"""Record linkage, reconciliation and catalogue normalisation as Spark DataFrame jobs."""
