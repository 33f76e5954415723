"""Addresses of files in the shared scratch folder, as tasks open them."""

from __future__ import annotations

import pyarrow.fs


def local_uri(path: str) -> str:
    """Spark prints local paths as ``file:/x``; other readers want ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return path.replace("file:/", "file:///", 1)
    return path if "://" in path else f"file://{path}"


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(local_uri(path))
