"""Settings: files of KEY=VALUE lines, YAML trees, and paths relative to a root."""

from __future__ import annotations

from collections.abc import MutableMapping
from pathlib import Path


def read_settings(path: str | Path) -> dict[str, str]:
    """The settings of a file: what follows # is a comment, lines without = are none. A file that isn't there has none."""
    file = Path(path)
    lines = file.read_text(encoding="utf-8").splitlines() if file.exists() else []
    pairs = (line.split("#")[0].partition("=") for line in lines)
    return {k.strip(): v.strip() for k, sign, v in pairs if sign and k.strip()}


def read_tree(path: str | Path) -> dict:
    """The settings of a YAML file, nested as they are there. A file that isn't there or is empty has none; one that holds anything but named settings is an error."""
    import yaml

    file = Path(path)
    said = yaml.safe_load(file.read_text(encoding="utf-8")) if file.exists() else None
    if said is not None and not isinstance(said, dict):
        raise ValueError(f"{path} doesn't hold named settings")
    return said or {}


def setting(tree: dict, name: str, usual=None):
    """A setting by its names, apart by dots; what is usual where one of them isn't there."""
    for part in name.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return usual
        tree = tree[part]
    return tree


def apply_settings(path: str | Path, to: MutableMapping[str, str]) -> None:
    """Settings that aren't there yet."""
    for key, value in read_settings(path).items():
        to.setdefault(key, value)


def rooted(path: str | Path, root: str | Path) -> Path:
    return Path(path) if Path(path).is_absolute() else Path(root) / path
