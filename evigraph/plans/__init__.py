"""Queries over the given tables; importing a plan module registers its queries."""
