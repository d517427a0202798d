"""Layered settings of the vision service."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

#: Environment names begin with this; an unset or zero limit becomes TOKENS.
PREFIX, TOKENS = "PRISMLAKE_", 600


@dataclass(frozen=True)
class VisionConfig:
    provider: str = ""
    endpoint: str = ""
    model: str = ""
    api_key: str = ""
    max_tokens: int = 0

    def __repr__(self) -> str:
        """Without the key, which must not reach plans or logs."""
        return f"VisionConfig({self.provider!r}, {self.endpoint!r}, {self.model!r}, max_tokens={self.max_tokens})"

    def usable(self) -> bool:
        return bool(self.endpoint and self.model)

    def over(self, other: VisionConfig) -> VisionConfig:
        """This layer, with other's values where it has none."""
        return VisionConfig(*(getattr(self, f) or getattr(other, f) for f in self.__dataclass_fields__))


def key_values(text: str) -> dict[str, str]:
    """The same rules as parsers.key_values, on the driver."""
    lines = (x.strip() for x in text.splitlines())
    pairs = (x.split("=", 1) for x in lines if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip() for k, v in pairs}


def _layer(values: Mapping[str, str], suffix: str = "") -> VisionConfig:
    n = values.get("max_tokens", "")
    return VisionConfig(*(values.get(k + suffix, "") for k in ("provider", "endpoint", "model", "api_key")), int(n) if n.isdecimal() else 0)


def _file(path: str | None) -> dict[str, str]:
    try:
        with open(path or "", encoding="utf-8") as f:
            return key_values(f.read())
    except (OSError, UnicodeDecodeError):
        return {}


def resolve(given: VisionConfig, config: str | None = None, legacy: str | None = None, env: Mapping[str, str] | None = None) -> VisionConfig:
    """Given values over the environment over the file; over the old file (names ending in 2) if that isn't usable. Unreadable files are empty."""
    env = os.environ if env is None else env
    out = given.over(_layer({k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})).over(_layer(_file(config)))
    if not out.usable() and legacy:
        out = out.over(replace(_layer(_file(legacy), "2"), max_tokens=0))
    return out if out.max_tokens else replace(out, max_tokens=TOKENS)


EXAMPLE = "# settings of the vision service\nprovider =\nendpoint =\nmodel =\napi_key =\nmax_tokens = 600\n"
