"""Safe boundaries for byte-level BPE: no match of the usual split pattern crosses from a non-space to a white-space character.

Each alternative of the pattern is either white space alone or an optional space before non-space characters, so such a place is always a match's end; the pattern looks ahead only over white space, and never back. Encoding the segments between such places one by one therefore gives the ids of the whole text.
"""

from __future__ import annotations

import re

#: Unicode's White_Space property (fixed values), which is \s of the pattern. Python's own \s has more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def segments(text: str) -> list[str]:
    """White space and the word after it; together they are the text."""
    return SEGMENT.findall(text)
