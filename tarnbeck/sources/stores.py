"""Files by path or URI: local ones as they are, others through Arrow's file systems."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    """The plain path of a local file or file: URI, else None."""
    u = urlparse(uri)
    if u.scheme == "file":
        return unquote(u.path)
    return uri if u.scheme == "" else None


def _store(uri: str):
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3{sep}{rest}" if scheme in ("s3a", "s3n") else uri)


def opened(uri: str) -> io.BufferedIOBase:
    """A file for reading, with seek."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    store, path = _store(uri)
    return io.BufferedReader(store.open_input_file(path), 1 << 20)


def read_bytes(uri: str) -> bytes:
    with opened(uri) as f:
        return f.read()


def files_below(root: str, suffixes: tuple[str, ...]) -> Iterator[tuple[str, int]]:
    """(path or URI, bytes) of the files below a folder, or of the file itself, in order of their names; hidden ones left out."""
    path = local_path(root)
    if path is not None:
        if os.path.isfile(path):
            yield path, os.path.getsize(path)
            return
        for folder, below, names in os.walk(path):
            below[:] = sorted(d for d in below if not d.startswith((".", "_")))
            for n in sorted(names):
                if n.lower().endswith(suffixes) and not n.startswith((".", "_")):
                    yield f"{folder}/{n}", os.path.getsize(f"{folder}/{n}")
        return
    from pyarrow import fs

    store, path = _store(root)
    base = root[: len(root) - len(path)] if root.endswith(path) else root.split("://")[0] + "://"
    found = [store.get_file_info(path)] if store.get_file_info(path).is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        hidden = any(p.startswith((".", "_")) for p in f.path[len(path) :].split("/"))
        if f.is_file and f.path.lower().endswith(suffixes) and not hidden:
            yield base + f.path, f.size
