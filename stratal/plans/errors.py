"""Errors of the SQL dialect."""


class DialectError(ValueError):
    """A query that the dialect does not take."""


class ParseError(DialectError):
    """The text is not a query."""


class AnalysisError(DialectError):
    """The query does not fit the tables: names, types, grouping."""


class ResourceExhausted(RuntimeError):
    """A limit on rows or memory was passed."""


class MemoryLimit(ResourceExhausted):
    """A query needs, or is expected to need, more memory than its limit."""


class JobFailed(RuntimeError):
    """A scheduled query failed, was cancelled or came too late."""
