"""Sentences of a paragraph, shared by the operators that judge prose."""

from __future__ import annotations

import re

_ABBREVIATION = re.compile(r"\b(Mr|Mrs|Ms|Dr|Prof|St|No|Fig|e\.g|i\.e|cf|vs|p)\.(?=\s)")
_END = re.compile(r"(?<=[.!?])[\"”’)\]]*\s+(?=[\"“‘(\[]?[A-Z0-9])|(?<=[.!?])\s+(?=[a-z])|\n+(?=[\"“(\[]?[A-Z0-9])|\n\s*\n")
_HYPHEN = re.compile(r"(?<=[a-z])[-­¬]\n(?=[a-z])")
_BULLET = re.compile(r"^\s*(?:[-*•–—▪◦●■‣+·>]|\(?\d{1,3}[.)]|\[[ xX]?\])\s+", re.M)


def sentences(text: str) -> list[str]:
    """Sentences of a text. Lines broken at the margin are joined; lines that all
    begin like sentences are sentences of their own."""
    text = _BULLET.sub("", _HYPHEN.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))
    text = _ABBREVIATION.sub(lambda m: m.group(1) + "\x00", text)
    if re.search(r"\n[a-z(]", text):
        text = re.sub(r"[ \t]*\n(?!\n)", " ", text)
    return [" ".join(s.replace("\x00", ".").split()) for s in _END.split(text) if s and s.strip()]
