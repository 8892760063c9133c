"""Copy tables with Spark and prove that they arrived intact."""
