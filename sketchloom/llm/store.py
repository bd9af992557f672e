"""Files of our own in a folder that all executors share, by way of pyarrow's file systems."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path there; a plain path is local."""
    if "://" in folder or folder.startswith("file:/"):
        if folder.startswith("file:/") and not folder.startswith("file://"):
            folder = "file://" + folder[len("file:") :]
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file under another name, then moves it into place: a reader finds all of it or none, and a repeated task does no harm."""
    store.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as out:
        out.write(data)
    settle(store, draft, path)


def settle(store: fs.FileSystem, draft: str, path: str) -> None:
    """Moves a draft into place; where a store doesn't move onto a file, one that an earlier try left makes room."""
    try:
        store.move(draft, path)
    except OSError:
        if not there(store, path):
            raise
        store.delete_file(path)
        store.move(draft, path)


def get(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def there(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == fs.FileType.File


def listed(folder: str, ending: str) -> list[tuple[str, int]]:
    """Path and size of the folder's files of that ending, sorted."""
    store, path = opened(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(ending))
