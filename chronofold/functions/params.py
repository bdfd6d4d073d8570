"""Settings and parameters from text, with defaults and strict errors."""

from __future__ import annotations

import secrets
from collections.abc import Mapping
from dataclasses import dataclass, fields

from .. import vocabulary as V
from .time import parse_ms


def duration_setting(values: Mapping[str, str], key: str, fallback_ms: int) -> int:
    """Milliseconds of a setting; absent or empty gives the fallback, anything but a duration is an error."""
    if not values.get(key):
        return fallback_ms
    try:
        return parse_ms(values[key])
    except ValueError as e:
        raise ValueError(f"{key}: {e}") from None


def duration_param(params: Mapping, key: str, fallback_ms: int) -> int:
    """Milliseconds of a fault's parameter, which must be a text with units if it is set."""
    if key not in params:
        return fallback_ms
    if not isinstance(params[key], str):
        raise ValueError(f'{key} must be a duration such as "250ms", not {params[key]!r}')
    return duration_setting(params, key, fallback_ms)


def int_param(params: Mapping, key: str, fallback: int) -> int:
    """An integer parameter of a fault; a float is cut."""
    v = params.get(key, fallback)
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise ValueError(f"{key} must be an integer, not {v!r}")
    return int(v)


def _numbers(raw: str, flag: str, kind, good, what: str) -> list:
    out = []
    for part in filter(None, map(str.strip, raw.split(","))):
        try:
            v = kind(part)
        except ValueError:
            v = None
        if v is None or not good(v):
            raise ValueError(f"{flag}: {part!r} is not {what}")
        out.append(v)
    if not out:
        raise ValueError(f"{flag}: no values given")
    return out


def int_list(raw: str, flag: str) -> list[int]:
    """Positive integers between commas."""
    return _numbers(raw, flag, int, lambda v: v > 0, "a positive integer")


def fraction_list(raw: str, flag: str) -> list[float]:
    """Fractions from 0 to 1 between commas."""
    return _numbers(raw, flag, float, lambda v: 0 <= v <= 1, "a fraction between 0 and 1")


def new_seed() -> int:
    """A seed for a run that is given none: positive, of 63 bits."""
    return secrets.randbelow((1 << 63) - 1) + 1


@dataclass(frozen=True)
class Timing:
    """Periods in milliseconds, and missed beats to suspicion and loss."""

    lease_ms: int = V.LEASE_MS
    renew_ms: int = V.RENEW_MS
    beat_ms: int = V.BEAT_MS
    reaper_ms: int = V.REAPER_MS
    timeout_ms: int = V.TIMEOUT_MS
    suspect_after: int = V.SUSPECT_AFTER
    lost_after: int = V.LOST_AFTER

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Timing:
        """From settings named as the fields, in upper case; durations have units, counts do not."""
        found = {}
        for f in fields(cls):
            key = f.name.upper()
            if f.name.endswith("_ms"):
                found[f.name] = duration_setting(values, key, f.default)
            elif values.get(key):
                found[f.name] = int_list(values[key], key)[0]
        return cls(**found)

    def problems(self) -> list[str]:
        """Why this timing cannot work; empty if it can. A renewal must be able to fail once without losing the lease, and
        one missed beat never means failure."""
        out = [f"{f.name} must be positive" for f in fields(self) if f.name.endswith("_ms") and getattr(self, f.name) <= 0]
        if self.renew_ms * 2 > self.lease_ms:
            out.append("renew_ms must be at most half of lease_ms")
        if self.suspect_after < 2:
            out.append("suspect_after must be at least 2 beats")
        if self.lost_after <= self.suspect_after:
            out.append("lost_after must exceed suspect_after")
        return out
