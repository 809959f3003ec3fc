"""marksmith: Spark-native data engine for model-fingerprint registries and audits.

Every operator is a DataFrame -> DataFrame function built from native Spark
expressions; see ``marksmith.operators``.
"""

__version__ = "0.1.0"
