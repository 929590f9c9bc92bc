"""lorewell: project-context retrieval and corpus preparation on Spark DataFrames."""
