"""Helpers for code that runs inside Python workers: state that outlives a task, bounded batches, cached pieces."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Bytes of binary output after which a worker sends a batch back.
BATCH_BYTES = 16 << 20

#: Characters of a text that are split into pieces at once.
BLOCK_CHARS = 1 << 20


def worker_state(key: str, make: Callable[[], object]) -> object:
    """``make()`` once for each Python worker; Spark reuses workers over tasks, while functions are shipped with each."""
    home = sys.modules.setdefault("_postlens_worker_state", types.ModuleType("_postlens_worker_state")).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


def rest_of(columns: Iterable[str], *made: str) -> list[str]:
    """The columns that an operator passes on.

    Left out are those it makes itself, which replace equal names, and all that begin with ``_llm_``: such names are the
    operators' own, and input columns of that kind are dropped.
    """
    taken = {name.lower() for name in made}
    return [name for name in columns if name.lower() not in taken and not name.lower().startswith("_llm_")]


def add_binary(
    batches: Iterator[pa.RecordBatch], source: str, targets: list[str], make: Callable[[object], tuple[bytes, ...]], limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Replace column ``source`` by the binary columns ``targets`` = make(value), in batches of about ``limit`` bytes."""
    for batch in batches:
        place = batch.schema.get_field_index(source)
        kept = [(field, batch.column(i)) for i, field in enumerate(batch.schema) if i != place]
        values, first, size, made = batch.column(place), 0, 0, []
        for row in range(len(batch)):
            made.append(make(values[row].as_py()))
            size += sum(map(len, made[-1]))
            if size >= limit or row == len(batch) - 1:
                arrays = [column.slice(first, len(made)) for _, column in kept] + [pa.array(column, pa.binary()) for column in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[field.name for field, _ in kept] + targets)
                first, size, made = row + 1, 0, []


class Irregular(Exception):
    """A piece whose white space does not stand alone between two words."""


class Pieces(dict):
    """Packed ids of `` piece`` (with the space before it) for the pieces that ``str.split(" ")`` gives.

    A single space between two other characters always starts a new match of the splitting pattern, so what lies
    between such spaces can be encoded by itself. At ``limit`` entries the table is emptied, which bounds its memory.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = 500_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Irregular
        ids = self.encode(" " + piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids

    def blocks(self, text: str, size: int = BLOCK_CHARS) -> Iterator[bytes]:
        """The packed ids of ``text``, block by block. Blocks end where a single space follows a word."""
        start = 0
        while start < len(text):
            end = start + size
            while (end := text.find(" ", end)) > 0 and (text[end - 1].isspace() or text[end + 1 : end + 2].isspace() or end + 1 == len(text)):
                end += 1
            block = text[start:] if end < 0 else text[start:end]
            start += len(block)
            first, *rest = block.split(" ")
            try:
                if first and (first[0].isspace() or first[-1].isspace()):
                    raise Irregular
                yield (self.encode(first) if first else b"") + b"".join(map(self.__getitem__, rest))
            except Irregular:
                yield self.encode(block)
