"""Source-corpus audit on Spark: files in, located and ranked findings out."""
