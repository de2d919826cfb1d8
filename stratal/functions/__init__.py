"""Column builders with the semantics of the dialect."""
