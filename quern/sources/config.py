"""Settings of a server from a key=value file."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    port: int = 80
    backlog: int = 5
    interface: str = "lo"
    home: str = "/var"


#: Names in the file for the fields they set.
NAMES = {"port": "port", "back": "backlog", "ethname": "interface", "home_dir": "home", "homedir": "home"}


def read_config(text: str) -> Config:
    """Lines `key=value`; unknown keys, blank lines and lines that start with # don't matter, the last value of a key holds."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        key, sep, value = line.partition("=")
        if sep and not line.lstrip().startswith("#") and key.strip() in NAMES:
            found[NAMES[key.strip()]] = value.strip()
    kinds = {f.name: f.type for f in fields(Config)}
    return Config(**{k: int(v) if kinds[k] == "int" else v for k, v in found.items()})
