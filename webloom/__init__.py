"""Web-corpus analytics as Spark DataFrame pipelines."""
