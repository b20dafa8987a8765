"""Encoding a corpus with a public tokenizer, and decoding it again.

The vocabulary file is a parameter; it is shipped to the executors, and each
Python worker loads it once.  Texts are encoded whole, block by block of an Arrow
batch.  Where the file says that words end as byte-level vocabularies usually
have it, a text is encoded in pieces that end where a word surely does; with any
other file it is encoded as one.  A null or empty text gives an
empty list.  Strings that look like special tokens are ordinary text.

Byte-level vocabularies write each byte as one printable character.  ``decode``
reverses that table: tokens are joined as bytes and decoded as UTF-8 only at
the end, so characters split over several tokens come out whole; bytes that form no
character (a list cut inside one) become U+FFFD.  A null list decodes to null.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts encoded at once; bounds the memory that one call takes.
TEXTS_AT_ONCE = 64


def vocabulary(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Path of a public vocabulary file: in ``folder``, or where SPINDRIFT_TOKENIZERS or the default installation has it."""
    return os.path.join(folder or os.environ.get("SPINDRIFT_TOKENIZERS", "/opt/tokenizers"), name)


def _shipped(spark: SparkSession, path: str) -> str:
    """``path``, its file being sent along to every executor that has none there."""
    spark.sparkContext.addFile(path)
    return path


def _local(path: str) -> str:
    """On a worker: the file itself, or the copy that was shipped."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_local(path))
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """Byte -> its character in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of every token id of a byte-level vocabulary file; special tokens are their UTF-8 text."""
    back = {c: b for b, c in byte_characters().items()}
    with open(_local(path), encoding="utf-8") as f:
        data = json.load(f)
    special = {t["id"]: t["content"] for t in data.get("added_tokens", [])}
    out = [b""] * (max([*data["model"]["vocab"].values(), *special]) + 1)
    for token, i in data["model"]["vocab"].items():
        out[i] = token.encode() if i in special else bytes(back[c] for c in token)
    for i, token in special.items():
        out[i] = token.encode()
    return out


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё一-龥ぁ-んァ-ヶ"
#: Where a byte-level tokenizer always begins a new word, whatever its Unicode version: before white space that follows
#: a visible character, and before a letter that follows a CJK full stop.  Nothing after such a place depends on what is before it.
_CUT = re.compile(rf"(?<=[!-~。{_LETTERS}])(?=[ \n\r\t])|(?<=。)(?=[{_LETTERS}])")


@lru_cache(maxsize=4)
def cuts_are_sure(path: str) -> bool:
    """Whether the vocabulary file splits words by the byte-level pattern, with nothing before it that changes texts: then _CUT holds."""
    with open(_local(path), encoding="utf-8") as f:
        data = json.load(f)
    before = data.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before]) if before.get("type") == "Sequence" else [before]
    plain = [x.get("type") for x in steps] == ["ByteLevel"] and steps[0].get("use_regex", True) and not steps[0].get("add_prefix_space", False)
    # a token added to the vocabulary is sought before words are split; those that are special are ordinary text here
    return bool(plain and data.get("normalizer") is None and all(t.get("special") for t in data.get("added_tokens", [])))


#: Pieces whose ids a worker remembers before it forgets them all.
PIECES = 200_000


class _Pieces:
    """Ids of whole texts, joined from the ids of their pieces.

    A text is cut where the tokenizer cuts it anyway, so the ids of the pieces
    one after the other are the ids of the text; pieces seen before (most words
    of a language) needn't be encoded again.
    """

    def __init__(self, path: str) -> None:
        self.tok = _tokenizer(path)
        self.known: dict[str, bytes] = {"": b""}
        self.sure = cuts_are_sure(path)

    def ids(self, texts: list) -> list[bytes]:
        """The ids of each text as int32 bytes; null counts as empty."""
        import numpy as np

        if len(self.known) > PIECES:
            self.known = {"": b""}
        cut = [(_CUT.split(t) if self.sure else [t]) if t else [""] for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if new:
            for p, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
                self.known[p] = np.asarray(e.ids, dtype=np.int32).tobytes()
        get = self.known.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        if not self.sure:  # whole texts aren't worth remembering
            self.known = {"": b""}
        return out


@lru_cache(maxsize=4)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def _blocks(texts: list, pieces: _Pieces) -> Iterator[list[bytes]]:
    for i in range(0, len(texts), TEXTS_AT_ONCE):
        yield pieces.ids(texts[i : i + TEXTS_AT_ONCE])


def _ids(texts: list, pieces: _Pieces) -> pa.Array:
    import numpy as np

    parts = [x for block in _blocks(texts, pieces) for x in block]
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _small(b: pa.RecordBatch, at: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``b`` cut so that no part has more than ``limit`` bytes of text, or is one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        if total + s > limit and i > lo:
            yield b.slice(lo, i - lo)
            lo, total = i, 0
        total += s
    if lo < b.num_rows:
        yield b.slice(lo)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``text`` replaced by ``out``, an array of ints; the other columns are kept as they are."""
    path = _shipped(df.sparkSession, path or vocabulary())
    at = df.columns.index(text)
    schema = T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()), False) if f.name == text else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for whole in batches:
            for b in _small(whole, at):
                cols = list(b.columns)
                cols[at] = _ids(b.column(at).to_pylist(), pieces)
                yield pa.RecordBatch.from_arrays(cols, names=[out if i == at else n for i, n in enumerate(b.schema.names)])

    return df.mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with ``text`` replaced by its number of tokens (0 for null and empty)."""
    path = _shipped(df.sparkSession, path or vocabulary())
    at = df.columns.index(text)
    schema = T.StructType([T.StructField(out, T.LongType(), False) if f.name == text else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for whole in batches:
            for b in _small(whole, at):
                cols = list(b.columns)
                cols[at] = pa.array([len(x) // 4 for block in _blocks(b.column(at).to_pylist(), pieces) for x in block], pa.int64())
                yield pa.RecordBatch.from_arrays(cols, names=[out if i == at else n for i, n in enumerate(b.schema.names)])

    return df.mapInArrow(run, schema)


def offsets(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """(key, position, id, start, end) of every token; start and end are code points of the text, end exclusive.

    Tokens inside one character all point to that character.
    """
    path = _shipped(df.sparkSession, path or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tok = _tokenizer(path)
        for whole in batches:
            for b in _small(whole, 1, 1 << 20):
                for k, t in zip(b.column(0), b.column(1).to_pylist()):
                    if not t:
                        continue
                    e = tok.encode(t, add_special_tokens=False)
                    n = len(e)
                    span = np.asarray(e.offsets, dtype=np.int32).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, b.column(0).type), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.asarray(e.ids, np.int32)), pa.array(span[:, 0]), pa.array(span[:, 1])], names=["key", "position", "id", "start", "end"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, position int, id int, start int, end int").withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the list ``ids`` replaced by the text it stands for.  An id outside the vocabulary raises an error."""
    path = _shipped(df.sparkSession, path or vocabulary())
    at = df.columns.index(ids)
    schema = T.StructType([T.StructField(out, T.StringType()) if f.name == ids else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            cols = list(b.columns)
            texts = [None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[out if i == at else n for i, n in enumerate(b.schema.names)])

    return df.mapInArrow(run, schema)
