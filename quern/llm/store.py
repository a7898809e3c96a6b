"""Tables between the stages of an operator: those of ``quern.sources.shared`` under the names that the operators use."""

from __future__ import annotations

from quern.sources.shared import cleared, dropped, folder, kept, kept_at, new_path

shared_dir, staged, staged_at = folder, kept, kept_at

__all__ = ["cleared", "dropped", "new_path", "shared_dir", "staged", "staged_at"]
