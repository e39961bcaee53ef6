"""Composite plans (whole analysis) and lineage helpers."""

from .lineage import checkpoint_dir, materialize, release

__all__ = ["checkpoint_dir", "materialize", "release"]
