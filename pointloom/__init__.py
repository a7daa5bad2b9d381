"""Analytics of point catalogs on Spark: cells, pairs, neighbour counts and estimators as DataFrames."""
