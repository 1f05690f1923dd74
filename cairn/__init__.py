"""cairn: code and document retrieval, session analytics and log parsing as Spark DataFrames."""
