"""veinstone: a Spark-first engine for harvesting, indexing and searching archival descriptions."""
