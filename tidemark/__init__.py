"""Spark-first evidence-graph analytics: series, graph, text and catalog operators as DataFrame plans."""
