"""A graph-pattern query engine over tables, files and triples, compiled to Spark DataFrames."""
