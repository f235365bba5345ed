"""Words: longest runs of letters and digits of any script, lower-cased."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null."""
    return WORD.findall(text.lower()) if text else []
