"""Path forms."""

from __future__ import annotations

import os


def canonical_path(root: str, path: str) -> str:
    """path, taken from the working directory, relative to root, with forward slashes; root itself is ""."""
    relative = os.path.relpath(os.path.abspath(path), root)
    return "" if relative == "." else relative.replace(os.sep, "/")
