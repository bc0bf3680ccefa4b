"""boxtrail: evidence-grounding analytics on Spark DataFrames."""
