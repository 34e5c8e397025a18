"""jobsieve: job-posting analytics as Spark DataFrame, ML and Structured Streaming jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions; nothing is collected to the driver except tiny, size-bounded
results (a verdict, a p-value input of a handful of numbers).
"""

__version__ = "0.1.0"
