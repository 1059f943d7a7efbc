"""Breezeline: keyed measurement streams on Spark.

Landed API responses become flat readings, readings are scored against a
moving average of their city's last values, alerts and a keep-first history
come out, and lookups answer current status and latest-k history.
"""
