"""Chain-transfer analytics as PySpark DataFrame functions."""
