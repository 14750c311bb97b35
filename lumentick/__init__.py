"""lumentick: keyed, ordered market-data analytics expressed as Spark DataFrame plans."""
