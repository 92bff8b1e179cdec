"""emberline: rule-based event detection and hybrid retrieval as Spark DataFrame plans."""
