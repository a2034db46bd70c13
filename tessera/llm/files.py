"""Files in the shared folder, written and read inside tasks on any store that Arrow opens."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """A file's store and its path there. The scheme says which; a bare path would be another place on each executor."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", uri):
        raise ValueError(f"a path without a scheme: {uri}")
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def write_file(uri: str, data: bytes) -> None:
    """Whole or not at all: a task that is tried again writes the same name."""
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def read_file(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        if offset:
            f.seek(offset)
        return f.read() if length is None else f.read(length)
