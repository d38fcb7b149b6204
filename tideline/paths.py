"""Input paths on the driver."""

from __future__ import annotations

import os
from pathlib import Path


def resolve(path: str, home: str | None = None, cwd: str | None = None) -> Path:
    """An absolute path: a leading ~ is the home folder, . vanishes, .. is refused and links are not followed."""
    parts = Path(path).parts
    if ".." in parts:
        raise ValueError("a path must not step upwards")
    if parts[:1] == ("~",):
        base = home or os.environ.get("HOME")
        if not base:
            raise ValueError("a leading ~ needs HOME")
        return Path(base, *parts[1:])
    return Path(cwd or os.getcwd(), *parts)
