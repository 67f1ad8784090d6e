"""Files in the shared folder, by URI, for code that runs in Python on executors."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = at(uri)
    system.create_dir(path, recursive=True)


@contextlib.contextmanager
def written(uri: str):
    """A stream to a new file that gets its name only when it is whole: a lost or repeated task leaves no half file."""
    system, path = at(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    stream = system.open_output_stream(part, compression=None)
    try:
        yield stream
        stream.close()
        try:
            system.move(part, path)
        except OSError:  # a store that does not replace: an earlier run of the task has left the same file
            system.delete_file(path)
            system.move(part, path)
    except BaseException:
        with contextlib.suppress(OSError):
            stream.close()
            system.delete_file(part)
        raise


def opened(uri: str):
    """A file for range reads: read_at(size, offset), size()."""
    system, path = at(uri)
    return system.open_input_file(path)


def name(uri: str) -> str:
    return os.path.basename(uri)
