"""Settings of the library: defaults, a JSON file over them, secrets masked where they are shown."""

from __future__ import annotations

import json

#: Settings that are shown in part only.
SECRET = ("key", "token", "password")


def load(text: str | None, defaults: dict[str, object]) -> dict[str, object]:
    """Defaults with what a JSON text says over them: known names and their kinds only; a byte order mark is skipped, no text says nothing."""
    said = json.loads(text.lstrip("﻿")) if text and text.strip("﻿ \n\t") else {}
    if not isinstance(said, dict):
        raise ValueError("settings are a JSON object")
    fits = lambda k, v: k in defaults and (defaults[k] is None or isinstance(v, type(defaults[k])))
    return defaults | {k: v.strip() if isinstance(v, str) else v for k, v in said.items() if fits(k, v)}


def shown(settings: dict[str, object]) -> dict[str, object]:
    """Settings with their secrets masked: four characters of either end, or none of a short one."""

    def mask(v: str) -> str:
        return v if not v else "***" if len(v) <= 8 else f"{v[:4]}...{v[-4:]}"

    return {k: mask(v) if isinstance(v, str) and any(s in k.lower() for s in SECRET) else v for k, v in settings.items()}
