"""Review-quality and aspect-sentiment analytics as Spark DataFrame transformations."""
