"""Entity resolution and record linkage as Spark DataFrame plans."""
