"""Analytics over genomic variants, expressed as Spark DataFrame plans."""
