"""Binary files in the shared folder, from driver and executors alike, by URI."""

from __future__ import annotations

from pyarrow import fs as pafs


def at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    system, path = at(uri)
    system.create_dir(path, recursive=True)
    return uri


def create(uri: str):
    system, path = at(uri)
    return system.open_output_stream(path, compression=None)


def open_ranges(uri: str):
    """A file that can be read at any place."""
    system, path = at(uri)
    return system.open_input_file(path)
