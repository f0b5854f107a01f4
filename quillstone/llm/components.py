"""Connected components of an edge table."""

from __future__ import annotations

from quillstone.operators.graph import stars as components

__all__ = ["components"]
