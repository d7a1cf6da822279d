"""Operators over feature structs and score tables, as Column expressions and DataFrame plans."""
