"""Column builders whose results follow the reference dialect where Spark's own functions differ."""
