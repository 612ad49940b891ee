"""Distributed union-find, shared with the engine's graph operators."""

from ..operators.graph import connected_components

__all__ = ["connected_components"]
