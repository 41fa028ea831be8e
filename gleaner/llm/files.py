"""Files written by tasks into the shared folder, safe against tasks that are run again."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_in(uri: str):
    """A seekable input file."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def make_dir(uri: str) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)


@contextmanager
def published(uri: str):
    """An output stream whose content appears under uri only when it is complete; a second attempt replaces the first.

    Not every store renames onto an existing file, so the one of an earlier attempt goes before.
    """
    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        yield out
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(part, path)
