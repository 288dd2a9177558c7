"""What a run was: its settings' hash, when, on what."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from enum import Enum


def _plain(value):
    return value.value if isinstance(value, Enum) else value


def config_hash(config: Mapping) -> str:
    """SHA-256 of the settings as compact JSON with sorted keys; what JSON can't say is a TypeError."""
    plain = {str(_plain(k)): _plain(v) for k, v in config.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Provenance:
    module: str
    domain: str
    dataset_id: str | None
    config_hash: str
    run_timestamp: str
    software_version: str
    extra: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {k: _plain(v) for k, v in vars(self).items()} | {"extra": {str(_plain(k)): _plain(v) for k, v in self.extra.items()}}


def make_provenance(module, domain, dataset_id, config: Mapping, version: str, extra: Mapping | None = None) -> Provenance:
    return Provenance(str(_plain(module)), str(_plain(domain)), dataset_id, config_hash(config), datetime.now(timezone.utc).isoformat(), version, dict(extra or {}))


class _Context(logging.LoggerAdapter):
    def process(self, msg, kwargs):
        return f"{msg} {json.dumps(self.extra, sort_keys=True, default=str)}" if self.extra else msg, kwargs


def get_logger(name: str, **context) -> logging.LoggerAdapter:
    """One handler, nothing passed on to the root logger, the context as JSON in each record."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
        log.propagate = False
    return _Context(log, context)
