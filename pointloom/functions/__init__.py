"""Column expressions: coordinates, bins, kernels, cosmology, sky pixels."""
