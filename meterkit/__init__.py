"""meterkit: usage metering, estimation and pricing as Spark DataFrame code.

Every public operator is a function ``DataFrame(s) -> DataFrame``; nothing is
collected to the driver except single-row cursor lookups and size checks of
dimension tables before a broadcast.
"""

__version__ = "0.1.0"
