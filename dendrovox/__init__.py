"""Volume and neuron-tree analytics on Spark DataFrames."""
