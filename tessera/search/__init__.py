"""Search for formulas: sampling, tree operators, a niche archive, islands and gates.  Driver-side."""
