"""Files of stores as workers open them: local folders and whatever Arrow has a file system for."""

from __future__ import annotations

import re

import pyarrow.fs as pfs


def opened(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Paths without a scheme are local or on a mounted share."""
    path = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "/", path))
    return (pfs.LocalFileSystem(), path) if "://" not in path else pfs.FileSystem.from_uri(path)


def exists(fs: pfs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pfs.FileType.NotFound


def whole(path: str) -> bytes:
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        return f.read()


def below(path: str) -> list[pfs.FileInfo]:
    """The files below a folder, in order of their paths; of a file that itself."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pfs.FileType.File:
        return [info]
    found = fs.get_file_info(pfs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((x for x in found if x.type == pfs.FileType.File), key=lambda x: x.path)


class Ranged:
    """A file as a sequence of bytes of which slices are read when they are asked for."""

    def __init__(self, path: str) -> None:
        fs, at = opened(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, where: slice) -> bytes:
        start, stop, _ = where.indices(self.size)
        return self.file.read_at(max(0, stop - start), start)

    def all(self) -> bytes:
        return self[:]
