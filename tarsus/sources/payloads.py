"""Reading JSON payloads that may be padded, marked with a byte order mark, or wrapped as text once or more."""

from __future__ import annotations

import json


def read_object(payload: str | None) -> dict | list | None:
    """The object (or array) a payload stands for; None if it cannot be read or stands for anything else.

    Text inside the payload is read again, as deep as it is wrapped. Nesting deeper than the parser allows counts as
    unreadable. Of a repeated key the last value holds.
    """
    value: object = payload
    while isinstance(value, str):
        try:
            value = json.loads(value.strip("\ufeff \t\r\n\x00"))
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, (dict, list)) else None


def kind_of(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "text" if isinstance(value, str) else "object" if isinstance(value, dict) else "array"
