"""Signatures, the index, candidates, exact measures, graphs and what builds on them."""
