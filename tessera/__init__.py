"""tessera: a Spark-native ingestion engine for NumPy, NumPy-archive and Parquet files."""
