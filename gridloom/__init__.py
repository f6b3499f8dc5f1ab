"""Spark-native analytics engine for tabular data.

``gridloom.sources``    readers and writers
``gridloom.functions``  Column-level building blocks (labels, ranks, distribution tails)
``gridloom.operators``  DataFrame -> DataFrame operators
``gridloom.plans``      pipelines and the registered queries
``gridloom.streaming``  fitted transforms applied to streams
"""
