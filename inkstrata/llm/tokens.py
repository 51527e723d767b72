"""Token ids of a public byte-level BPE, and documents cut into pieces of a sequence's length.

The ids are those of the ``tokenizers`` file. Its library works at about 3 MB a second and core; ``tiktoken`` has the same
vocabulary as ranks and gives the same ids at four times that rate, so texts of plain characters go through tiktoken, and
any text with another character, a special token's string, or a very long run goes through ``tokenizers`` (the tests hold
the two against each other).
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices, utf8

#: Characters on which both libraries' tables of letters and spaces surely agree (Latin blocks and common
#: punctuation), and runs from which the fast path is left.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-ſ‐-―‘-‟•…€]|(?<!\\S)\\S{400}|\\s{100}")
PART_CHARS = 1 << 20


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """ids(text) by the vocabulary file; ``ranks`` is the same vocabulary for tiktoken, or None to do without it."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def slow(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def part(self, text: str) -> list[int]:
        if self.fast is None or ODD.search(text) or any(s in text for s in self.special):
            return self.slow(text)
        return self.fast.encode_ordinary(text)

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(self.part(x), np.uint32) for x in parts(text)])


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cuts a huge text before a single space between two other characters; no token spans such a place."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and (text[cut - 1].isspace() or cut + 1 >= len(text) or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None, pattern: str | None) -> Encoder:
    """One a worker process."""
    return Encoder(vocabulary, ranks, pattern)


def cut(total: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only what is longer than ``most`` is cut, and the first piece takes the rest."""
    first = total % most or most
    return [(0, first), *((at, most) for at in range(first, total, most))]


def _pieces(batches: Iterator[pa.RecordBatch], source: tuple, most: int, end: int, with_ids: bool, place: str | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    own = encoder(*source)
    for b in slices(batches):
        out: dict[str, list] = {f: [] for f in schema.names}
        at_ = b.column(place).to_pylist() if place else [None] * b.num_rows
        for doc, text, where in zip(b.column("doc_id").to_pylist(), utf8(b), at_, strict=True):
            ids = np.append(own.ids(text.decode()), np.uint32(end)).astype("<u4")
            for k, (at, n) in enumerate(cut(len(ids), most)):
                piece = ids[at : at + n]
                for name, value in (("doc_id", doc), ("piece", k), ("start", at), ("length", n), ("ids_crc32", zlib.crc32(piece.tobytes()))):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(piece.astype(np.int32))
                if place:
                    out[place].append(where)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def pieces(
    df: DataFrame, most: int = 1024, end: int = 2, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken",
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", place: str | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids: a text's ids, then ``end``, cut to ``most`` at most; the
    column ``place`` (long) is carried along if it is named.

    ``vocabulary`` and ``ranks`` are names of public_tokenizers or paths. Null text is empty and has the one id ``end``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = id_and_text(df, *([place] if place else []), id_col=id_col, text_col=text_col)
    found = lambda n: n if n is None or "/" in n else public_path(n)
    source = (found(vocabulary), found(ranks), public_pattern() if ranks else None)
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + f", {place} long" * bool(place)
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)
    return docs.mapInArrow(partial(_pieces, source=source, most=most, end=end, with_ids=with_ids, place=place, schema=schema), ddl)


def total_tokens(found: DataFrame) -> int:
    return found.agg(F.sum("length")).first()[0] or 0
