"""readloom: analytics over large collections of short, noisy, positioned strings, on Spark DataFrames."""
