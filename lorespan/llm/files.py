"""Binary files in any store that pyarrow can write and Spark can read."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def make_dir(path: str, without: str | None = None) -> None:
    """The folder, and in it no file whose name ends with `without`: what an earlier job has left there goes before this one starts."""
    store, at = _store(path)
    store.create_dir(at, recursive=True)
    if without:
        for info in store.get_file_info(fs.FileSelector(at)):
            if info.type == fs.FileType.File and info.path.endswith(without):
                store.delete_file(info.path)


@contextmanager
def written(path: str):
    """An output stream whose file appears at path only when it is whole: a lost or repeated task leaves no half file.

    A whole file that an earlier attempt at the same content has left stays, as not every store replaces a file by a move.
    """
    store, at = _store(path)
    folder, _, name = at.rpartition("/")
    part = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        yield out
    if store.get_file_info(at).type == fs.FileType.NotFound:
        store.move(part, at)
    else:
        store.delete_file(part)
