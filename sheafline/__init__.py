"""Document-structuring analytics expressed as Spark DataFrame plans."""
