"""harrow: commodity time-series analytics as Spark jobs."""
