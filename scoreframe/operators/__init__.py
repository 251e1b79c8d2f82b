"""The scorers as objects, and their registry."""
