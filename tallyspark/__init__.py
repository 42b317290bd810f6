"""tallyspark: bid comparison, scoring, document planning and log analytics on PySpark."""
