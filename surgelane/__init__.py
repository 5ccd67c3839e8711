"""surgelane — Spark-native demand and surge analytics for trip tables.

Every public operator is a ``DataFrame -> DataFrame`` function meant for
``df.transform(op)``; nothing collects row data to the driver.
"""

__version__ = "0.1.0"
