"""lodestone: retrieval, answer-quality and corpus analytics as Spark DataFrames."""
