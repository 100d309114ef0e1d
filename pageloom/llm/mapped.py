"""Array files in the shared folder, written whole by tasks and mapped by workers."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


def local_path(path: str) -> str:
    """The path under which workers open shared files."""
    p = urlparse(path)
    if p.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped tables need a mounted shared folder, not {p.scheme}://")
    return p.path


def write_array(path: str, a: np.ndarray) -> None:
    """Write a whole file at once; a repeated task, on any machine, replaces it
    with the same bytes."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, a)
    os.replace(part, path)


def map_array(path: str) -> np.ndarray:
    """The file's array, read-only; only touched pages are held in memory."""
    return np.load(path, mmap_mode="r")
