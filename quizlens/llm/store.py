"""Files in the shared folder, by URI, through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else uri if sep else f"file://{uri.removeprefix('file:')}")


def write_whole(uri: str, write) -> int:
    """``write(stream)`` into a file that appears under its name only when complete; a repeated attempt replaces it with the same bytes. Returns its size."""
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as stream:
        write(stream)
    system.move(part, path)
    return system.get_file_info(path).size


def read_whole(uri: str) -> bytes:
    system, path = at(uri)
    with system.open_input_file(path) as f:
        return f.read()
