"""Errors of configuration and input. Plan problems share a base, so callers may catch them together."""


class GraphError(Exception):
    pass


class CatalogError(GraphError):
    pass


class PlanError(GraphError, ValueError):
    pass


class UnsupportedPlan(PlanError):
    pass


class AuthorizationError(PlanError):
    pass


class PolicyError(PlanError):
    pass


class EvidenceError(GraphError):
    pass
