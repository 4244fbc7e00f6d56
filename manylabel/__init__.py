"""Multi-label classification and nearest-neighbour label prediction on Spark DataFrames."""
