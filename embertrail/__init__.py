"""Log detection on Spark: sources, a flattener, rule predicates, correlations, summaries and sinks as DataFrame plans."""
