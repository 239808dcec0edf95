"""Document-retrieval analytics expressed as Spark DataFrame transformations."""
