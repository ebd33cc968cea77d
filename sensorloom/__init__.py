"""Sensor time-series analytics on PySpark."""
