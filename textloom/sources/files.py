"""Opening files from Python workers by the URIs Spark uses."""
from __future__ import annotations

import pyarrow.fs as pafs


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; plain paths and ``file:`` are local, s3a is S3."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        uri = "s3:" + rest
    return pafs.FileSystem.from_uri(uri)
