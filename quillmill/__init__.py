"""PySpark jobs that prepare and audit instruction-tuning data."""
