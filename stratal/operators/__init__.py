"""DataFrame forms of operators."""
