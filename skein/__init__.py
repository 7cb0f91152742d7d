"""skein: hybrid retrieval, knowledge-graph and text-lifecycle analytics on Spark DataFrames."""
