"""Mail-threat analytics as Spark jobs: DataFrame in, DataFrame out."""
