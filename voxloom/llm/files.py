"""Whole files written and read inside tasks, wherever the shared folder is."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import suppress
from typing import IO

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(path: str, write: Callable[[IO], None]) -> None:
    """Writes under a name of this attempt and moves it into place, so a repeated task leaves one whole file."""
    system, to = opened(path)
    system.create_dir(to.rsplit("/", 1)[0], recursive=True)
    draft = f"{to}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(draft) as out:
            write(out)
        system.move(draft, to)
    except BaseException:
        with suppress(OSError):
            system.delete_file(draft)
        raise


def get(path: str) -> IO:
    system, at = opened(path)
    return system.open_input_file(at)
