"""PySpark toolkit for the data work around multi-turn conversation models."""
