"""Settings from an INI file; a later file's keys stand before an earlier one's."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields


@dataclass
class Settings:
    host: str = "127.0.0.1"
    port: int = 3306
    user: str = ""
    password: str = ""
    log_level: str = "info"
    rate_limit: int = 30_000
    burst: int = 60_000
    batch_bytes: int = 250_000


def load(*paths: str, section: str = "engine") -> Settings:
    parser = configparser.ConfigParser()
    parser.read(paths)
    found = dict(parser[section]) if parser.has_section(section) else {}
    known = {f.name: f for f in fields(Settings)}
    unknown = sorted(set(found) - set(known))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Settings(**{k: int(v) if known[k].type == "int" else v for k, v in found.items()})
