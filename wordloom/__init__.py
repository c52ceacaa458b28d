"""wordloom — text features, lexicon scoring and label metrics as Spark jobs.

Every operator is a function over DataFrames; fitted state (vocabularies,
idf weights, class statistics) is itself a small DataFrame.  Nothing in the
hot path of the text features leaves the JVM except the explicit Python hook
``operators.inference``; ``llm`` holds the operations of a training-data pipeline.
"""

__version__ = "0.1.0"
