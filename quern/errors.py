"""One exception class; every failure carries a stable code."""

from __future__ import annotations


class QuernError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code
