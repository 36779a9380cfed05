"""rulespark: weighted, recursive rule programs executed as Spark DataFrame plans."""
