"""Errors that planning raises."""


class PlanError(ValueError):
    """A rule or a filter that the engine does not run."""
