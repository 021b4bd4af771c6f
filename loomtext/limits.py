"""Input limits and messages that are safe to print."""

from __future__ import annotations

import re

MAX_CHARACTERS = MAX_BYTES = 16 * 1024 * 1024


class InputLimitError(ValueError):
    """An input is larger than its limit; ``code`` also begins the message of a query that fails for this reason."""

    code = "input-limit"

    def __init__(self, found: int | None, most: int, unit: str = "characters"):
        super().__init__(f"{self.code}: {'' if found is None else f'{found:,} {unit}, '}more than {most} {unit}")


def checked_limit(value: int, name: str, least: int = 0) -> int:
    """``value`` if it is a whole number of ``least`` or more that a double holds exactly."""
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value < 2**53:
        raise ValueError(f"{name} must be a whole number of {least} or more")
    return value


def printable(message: str) -> str:
    """Control characters as question marks, so that a message cannot steer a terminal."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", "?", message)
