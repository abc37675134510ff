"""The models and the queries."""
