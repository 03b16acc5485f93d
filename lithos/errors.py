"""Errors of the engine."""

from __future__ import annotations


class LithosError(Exception):
    """Base of all errors of the engine."""


class WorldMismatch(LithosError):
    """A plan, view or transaction was used on another world."""


class ComponentMismatch(LithosError):
    """A result lacks a component that was asked for."""


class UnregisteredComponent(LithosError):
    """The planner needs a component the world doesn't know."""


class DeadEntity(LithosError):
    """A mutation names an entity that isn't alive."""


class AlreadyPlaced(LithosError):
    """A spawn names an entity that is alive already."""


class PoolExhausted(LithosError):
    """A spawn would exceed the world's memory budget."""


class BuilderOrder(LithosError):
    """A builder call came before the one it refers to."""


class InvalidPredicate(LithosError):
    """The arguments of a predicate make no sense."""


class SubscriptionError(LithosError):
    """All reasons why a subscription can't be built."""

    def __init__(self, reasons: list[str]):
        super().__init__("; ".join(reasons))
        self.reasons = reasons


class Conflict(LithosError):
    """A transaction lost against others on every attempt."""


class CursorBehind(LithosError):
    """A log cursor points before the oldest kept record."""


class FormatError(LithosError):
    """Stored data doesn't match its manifest or the registered components."""


class AccessViolation(LithosError):
    """A reducer touched a component that it did not declare."""


class WrongKind(LithosError):
    """A reducer was called in a way that its kind doesn't have."""
