"""Intermediate tables of the corpus operators: the helper of the library."""

from ..shared import drop, new_folder, save, shared_dir, shuffled

__all__ = ["drop", "new_folder", "save", "shared_dir", "shuffled"]
