"""Document analytics on Spark: text blocks, spans, brackets, style norms and small models as DataFrame plans."""
