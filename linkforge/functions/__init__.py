"""Scalar functions, written once as SQL expressions for a dialect; Spark evaluates them as built-in expressions."""
