"""Floating-car traffic analytics as Spark DataFrame and streaming operators."""
