"""Query and data operators."""
