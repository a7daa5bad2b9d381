"""Cell counts and pair increments over streams of points."""
