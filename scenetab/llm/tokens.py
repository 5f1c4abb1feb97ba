"""Words of whole texts as bytes, cut into runs of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

# bytes of a text that are split into words at once
RUN = 1 << 22


def byte_table(spaces: bytes, low: bool = True) -> bytes:
    """A translation that makes ``spaces`` blank, and lowers A-Z if asked to; bytes of other letters stay."""
    return bytes(32 if b in spaces else b + 32 if low and 65 <= b <= 90 else b for b in range(256))


# fixed values of the contracts: what is not a term of the search, and what is white space
TERMS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
BLANKS = byte_table(bytes([32, *range(9, 14)]))


def runs(text: bytes | None, table: bytes, apart: bytes = b"") -> Iterator[list[bytes]]:
    """The words of ``text`` after translation, in lists of some RUN bytes each; null has none. ``apart`` is a word wherever it stands."""
    data = (text or b"").translate(table)
    if apart:
        data = data.replace(apart, b" " + apart + b" ")
    at = 0
    while len(data) - at > RUN:
        end = data.find(b" ", at + RUN)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split() if at else data.split()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """The texts of a batch as bytes, one at a time."""
    for value in batch.column(name).cast(pa.large_binary()):
        yield value.as_py()
