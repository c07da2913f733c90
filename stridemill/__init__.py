"""Spark-native data work for series and model evaluation.

Sub-packages: ``functions`` (column and aggregate expressions), ``operators``
(DataFrame to DataFrame), ``sources`` (readers and writers), ``streaming``
(Structured Streaming forms) and ``plans`` (the registered queries).
"""
