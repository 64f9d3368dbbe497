"""pagelens: page audit and keyword analytics expressed as Spark DataFrame plans."""
