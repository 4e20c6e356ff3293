"""Typed refusals: one class per kind, so that callers can tell them apart."""


class CladeframeError(Exception):
    """Base of all refusals of this package."""


class ContractError(CladeframeError):
    """An input breaks a stated invariant."""


class AxisError(ContractError):
    """Keys do not agree between inputs, or repeat."""


class DomainError(ContractError):
    """A value lies outside its vocabulary or range."""


class RefusedError(CladeframeError):
    """The operation is not offered for this kind of object, by design."""


class StaleError(CladeframeError):
    """A stored result no longer matches what it was derived from."""


class TamperedError(CladeframeError):
    """A saved run does not match its inventory of hashes."""
