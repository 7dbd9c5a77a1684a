"""Settings from a ``.env`` file: ``KEY=VALUE`` lines under the real environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path

#: Names a file to be used instead of the search.
OVERRIDE = "DOTENV_PATH"
#: Folders above the working one that are searched.
MAX_PARENTS = 4

LINE = re.compile(r"\s*(?:export\s+)?([^=\s][^=]*?)\s*=(.*)", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def unquote(value: str) -> str:
    """A value without the quotes around it; escapes mean something in double quotes only."""
    v = value.strip()
    if len(v) < 2 or v[0] != v[-1] or v[0] not in "\"'":
        return v
    inner = v[1:-1]
    return inner if v[0] == "'" else re.sub(r"\\(.)", lambda m: ESCAPES.get(m.group(1), m.group(0)), inner)


def parse(path: str | os.PathLike) -> dict[str, str]:
    """The keys of a file in its order, a later one in place of an equal earlier one; none if it can't be read.

    Blank lines, comments and lines that are no assignment are passed over. The first ``=`` ends the key, ``#`` within a
    value belongs to it, nothing is expanded, an empty value stays an empty text.
    """
    try:
        text = Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError):
        return {}
    out: dict[str, str] = {}
    for line in text.lstrip("\ufeff").splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := LINE.fullmatch(line):
            out[m.group(1).strip()] = unquote(m.group(2))
    return out


def locate(start: str | os.PathLike | None = None, environment: Mapping[str, str] | None = None) -> Path | None:
    """The file to use: what ``DOTENV_PATH`` names if that is readable, else the nearest ``.env`` from ``start`` upwards."""
    named = (os.environ if environment is None else environment).get(OVERRIDE, "")
    if named.strip() and os.access(named, os.R_OK):
        return Path(named)
    here = Path(start or os.getcwd()).absolute()
    return next((d / ".env" for d in [here, *here.parents][: MAX_PARENTS + 1] if (d / ".env").is_file()), None)


def settings(start: str | os.PathLike | None = None, environment: Mapping[str, str] | None = None, defaults: Mapping[str, str] | None = None) -> dict[str, str]:
    """``defaults`` under the file's values under those of the real environment (of the keys that either has)."""
    env = os.environ if environment is None else environment
    path = locate(start, env)
    found = dict(defaults or {}) | (parse(path) if path else {})
    return {k: env.get(k, v) for k, v in found.items()}
