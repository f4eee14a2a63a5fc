"""Column expressions: amount parsing, text normalisation, tolerances."""
