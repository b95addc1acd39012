"""Containment of user-given paths."""

from pathlib import Path

from codeloom import constants as C
from codeloom.errors import PathOutsideRoot


def resolve(root, path, allow_sensitive: bool = False) -> Path:
    """Absolute form of a path that stays inside the root and is no credential file."""
    base = Path(root).resolve()
    target = (base / path).resolve()
    if target != base and base not in target.parents:
        raise PathOutsideRoot(f"path '{path}' lies outside '{base}'")
    if not allow_sensitive and (target.name in C.SENSITIVE_NAMES or target.suffix in C.SENSITIVE_SUFFIXES):
        raise PathOutsideRoot(f"file '{target.name}' is never served")
    return target


def relative(root, path) -> str:
    base, target = Path(root).resolve(), Path(path).resolve()
    return target.relative_to(base).as_posix() if target == base or base in target.parents else target.as_posix()
