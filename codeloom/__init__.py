"""codeloom: code-intelligence analytics expressed as Spark DataFrame plans."""
