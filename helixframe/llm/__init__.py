"""Training-data operators on PySpark.

Each module holds one operator with a general interface; ``queries`` applies
them to the driver's tables.  Nothing outside this folder imports it.
"""
