"""Connected components of links in a table, and checkpoints, for the text operators."""

from __future__ import annotations

from ..operators.components import components
from ..storage import checkpoint

__all__ = ["checkpoint", "components"]
