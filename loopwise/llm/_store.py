"""Intermediate tables in the folder that driver and executors share."""

from loopwise.store import arrow_bytes, drop, new_path, shared_dir, small, temporary, written

__all__ = ["arrow_bytes", "drop", "new_path", "shared_dir", "small", "temporary", "written"]
