"""Single files of a folder, for data source tasks: local paths, or any URI that Arrow's file systems know."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow.fs as pafs

from pulsegrid.errors import SignalError


@lru_cache(64)
def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.rstrip("/"))


def list_folder(folder: str) -> list[str]:
    fs, root = _place(folder)
    try:
        return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File)
    except FileNotFoundError as e:
        raise SignalError("file-not-found", f"{folder} does not exist") from e


def read_bytes(folder: str, name: str) -> bytes:
    fs, root = _place(folder)
    try:
        with fs.open_input_stream(f"{root}/{name}") as f:
            return f.read()
    except FileNotFoundError as e:
        raise SignalError("file-not-found", f"no file {name!r} in {folder}") from e


def list_sizes(folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the folder's files, by name; files of attempts, which begin with _, are left out."""
    fs, root = _place(folder)
    try:
        found = fs.get_file_info(pafs.FileSelector(root))
    except FileNotFoundError as e:
        raise SignalError("file-not-found", f"{folder} does not exist") from e
    return sorted((i.base_name, i.size) for i in found if i.type == pafs.FileType.File and not i.base_name.startswith("_"))


def size_of(folder: str, name: str) -> int:
    fs, root = _place(folder)
    info = fs.get_file_info(f"{root}/{name}")
    if info.type != pafs.FileType.File:
        raise SignalError("file-not-found", f"no file {name!r} in {folder}")
    return info.size


def read_range(folder: str, name: str, start: int, size: int) -> bytes:
    fs, root = _place(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        f.seek(start)
        return f.read(size)


def make_folder(folder: str) -> None:
    fs, root = _place(folder)
    fs.create_dir(root, recursive=True)


def write_bytes(folder: str, name: str, content: bytes) -> None:
    fs, root = _place(folder)
    with fs.open_output_stream(f"{root}/{name}") as f:
        f.write(content)


def rename_all(folder: str, names: list[tuple[str, str]]) -> None:
    """Gives each file (name, new name) its new name, some at a time: a store's answer takes longer than the asking."""
    fs, root = _place(folder)
    with ThreadPoolExecutor(16) as pool:
        for _ in pool.map(lambda f: fs.move(f"{root}/{f[0]}", f"{root}/{f[1]}"), names):
            pass


def remove(folder: str, names: list[str]) -> None:
    """Takes files away that may be gone already."""
    fs, root = _place(folder)
    for name in names:
        if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
            fs.delete_file(f"{root}/{name}")
