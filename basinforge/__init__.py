"""Analytics of coarse-grained Markov chains and interaction landscapes on DataFrames."""
