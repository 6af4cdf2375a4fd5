"""Errors that a request or model can raise."""


class QueryError(ValueError):
    """A request that can't be planned."""


class UnknownField(QueryError):
    pass


class AliasClash(QueryError):
    pass


class ForbiddenFunction(QueryError):
    pass


class ExpressionError(QueryError):
    pass


class InvalidSlice(QueryError):
    pass


class JoinPathError(QueryError):
    pass


class ScopeError(QueryError):
    pass


class AccessDenied(QueryError):
    pass
