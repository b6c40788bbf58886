"""lexloom: literary-corpus analytics and retrieval on Spark DataFrames."""
