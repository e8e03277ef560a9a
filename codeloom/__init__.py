"""Program-knowledge analytics on Spark: facts about software as DataFrames."""
