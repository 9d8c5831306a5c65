"""Words of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.

Texts are bytes of UTF-8: in these, a character beyond ASCII is a run of bytes from 0x80 on,
so the words are runs of bytes that can be told one by one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each byte becomes: word bytes stay, A-Z are lower-cased, others part words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def raw_text(name: str = "text") -> Column:
    """A text column as bytes, with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).cast("binary")
