"""What both text operators set aside before looking at words: line endings, odd characters and broken words."""

from __future__ import annotations

import re
import unicodedata

_BROKEN = re.compile(r"(?<=[A-Za-z])-[ \t]*\n[ \t]*(?:%+[ \t]*)?(?=[a-z])")
_ODD = re.compile(r"[^\w\s\x00-\x7f]")


def whole_words(text: str) -> str:
    """The text with plain line ends, ligatures and special blanks resolved, other odd signs as blanks, and words that a
    hyphen breaks at a line's end (in a comment too) put together again."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _ODD.sub(" ", unicodedata.normalize("NFKC", text.replace("\xad", "").replace("\u200b", "")))
    return _BROKEN.sub("", text) if "-" in text else text
