"""Folders of files that tasks read in parts and write whole: local or shared paths, and stores that pyarrow opens by URI."""

from __future__ import annotations

import glob as _glob
import os
import shutil
from typing import Any, BinaryIO


class Local:
    """Paths of a file system that driver and executors share."""

    def files(self, path: str) -> list[str]:
        """Files of a folder (none whose name begins with _ or .), of a glob, or the file itself; sorted."""
        if os.path.isdir(path):
            return [f for f in sorted(_glob.glob(f"{path}/*")) if os.path.isfile(f) and os.path.basename(f)[0] not in "_."]
        return sorted(_glob.glob(path))

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def size(self, path: str) -> int:
        return os.path.getsize(path)

    def open(self, path: str) -> BinaryIO:
        return open(path, "rb")

    def create(self, path: str) -> BinaryIO:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")

    def move(self, old: str, new: str) -> None:
        os.replace(old, new)

    def remove(self, path: str) -> None:
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.remove(path)


class Remote:
    """The same over a pyarrow file system."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, inner = fs.FileSystem.from_uri(uri)
        self.head = uri[: len(uri) - len(inner)] if uri.endswith(inner) else ""

    def _at(self, path: str) -> str:
        return path.removeprefix(self.head)

    def files(self, path: str) -> list[str]:
        from pyarrow import fs

        info = self.fs.get_file_info(self._at(path))
        if info.type != fs.FileType.Directory:
            return [path] if info.type == fs.FileType.File else []
        found = self.fs.get_file_info(fs.FileSelector(self._at(path)))
        return sorted(self.head + f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(self._at(path)).type.value > 1

    def size(self, path: str) -> int:
        return self.fs.get_file_info(self._at(path)).size

    def open(self, path: str) -> Any:
        return self.fs.open_input_file(self._at(path))

    def create(self, path: str) -> Any:
        self.fs.create_dir(self._at(path.rsplit("/", 1)[0]), recursive=True)
        return self.fs.open_output_stream(self._at(path))

    def move(self, old: str, new: str) -> None:
        self.fs.move(self._at(old), self._at(new))

    def remove(self, path: str) -> None:
        from pyarrow import fs

        kind = self.fs.get_file_info(self._at(path)).type
        if kind == fs.FileType.Directory:
            self.fs.delete_dir(self._at(path))
        elif kind == fs.FileType.File:
            self.fs.delete_file(self._at(path))


def store_of(path: str) -> Local | Remote:
    return Remote(path) if "://" in path else Local()


def plain(path: str) -> str:
    """path less file: before a local one, and less what it ends in."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return path.rstrip("/")
