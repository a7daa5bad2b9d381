"""Operators on point catalogs: cells, pairs, neighbour counts, windows, gradients."""
