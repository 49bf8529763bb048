"""Text normalisation shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones, and what they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ѵ": "v", "ԝ": "w", "һ": "h", "ӏ": "l", "ԛ": "q", "ґ": "r",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "ı": "i", "ɑ": "a", "ℓ": "l",
}
_ODD = re.compile("[" + "".join(LOOK_ALIKES) + "­​‌‍⁠﻿]")
_MARKS = re.compile("[\u0300-\u036f]+")
_MARKUP = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,200}>|&(?:nbsp|amp|quot|lt|gt|#\d+);")
_JOIN = re.compile(r"[-‐‑‒¬](?<=[^\W\d_].)\s*(?=[^\W\d_])")
_ASCII_JOIN = re.compile(r"-(?<=[a-z]-)\s*(?=[a-z])")
_WORDS = re.compile(r"[^\W_]+").findall
_DROPPED = "'’‘´`*_~"
_DROP = re.compile(f"[{_DROPPED}]")
_ASCII = {c: None if chr(c) in _DROPPED else c if chr(c).isalnum() else " " for c in range(128)}


def plain_words(text: str) -> list[str]:
    """Lower-case words without case, punctuation, layout, quote signs, markup, hyphens inside words, marks on letters and look-alikes."""
    if not text.isascii():
        text = _ODD.sub(lambda m: LOOK_ALIKES.get(m[0], "-" if m[0] == "­" else ""), _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold())
    else:
        text = text.lower()
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if text.isascii():
        return (_ASCII_JOIN.sub("", text) if "-" in text else text).translate(_ASCII).split()
    return _WORDS(_JOIN.sub("", _DROP.sub("", text)))
