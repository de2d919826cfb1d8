"""The dialect: syntax, compiler, engine, serving, and the query catalog."""
