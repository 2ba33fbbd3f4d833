"""Privacy dataflow over Spark DataFrames: detect, redact, score, route, restore, audit."""
