"""clausebase: clause-level document knowledge bases as Spark DataFrame plans."""
