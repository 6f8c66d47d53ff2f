"""millrace: fine-tuning data preparation on Spark.

``millrace.sources`` reads and writes, ``millrace.operators`` holds the dataset operators,
``millrace.streaming`` runs them on arriving files.
"""

__version__ = "0.1.0"
