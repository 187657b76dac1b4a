"""Intermediate tables; the engine's own module of staging, under the name that this subpackage uses."""

from ..staging import KEY, SMALL, clear, held, new_path, scope, shared_dir, spread, staged

__all__ = ["KEY", "SMALL", "clear", "held", "new_path", "scope", "shared_dir", "spread", "staged"]
