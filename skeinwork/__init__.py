"""skeinwork: analytics over code repositories and linked text, on Spark DataFrames."""
