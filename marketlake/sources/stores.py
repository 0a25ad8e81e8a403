"""File stores for readers that work inside tasks: local folders and whatever store pyarrow knows by URI."""

from __future__ import annotations


def store_of(uri: str):
    """(pyarrow file system, path within it) of a path or URI."""
    from pyarrow import fs
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
