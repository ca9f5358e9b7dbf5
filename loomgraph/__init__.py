"""Knowledge graph, news clustering and claim checking as Spark DataFrame jobs."""
