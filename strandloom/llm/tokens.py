"""Problem 6: encoding with a public byte-level tokenizer, over Arrow batches.

A byte-level BPE never merges across the pieces its pre-tokenizer pattern makes. So a task cuts each text with that pattern,
has the tokenizers library encode every *distinct* piece once, and joins the pieces' ids. Along with the ids it keeps how many
characters of a piece begin in each token (from the library's offsets, which map bytes to characters), so that offsets in
code points come for the price of a sum. Decoding reverses the byte table; a character that two tokens share is put
together again because bytes are joined before they are decoded.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of public vocabulary files and the split pattern of byte-level BPE.
FOLDER = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of at most so many characters are kept, and so many of them before the memory is emptied; neither changes a result.
KEPT_CHARS, KEPT = 40, 400_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Coder:
    """Encodes texts, piece by piece; made once per task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = regex.compile(PATTERN).findall
        self.ids: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encode those of `pieces` that are not known yet."""
        if len(self.ids) > KEPT:
            self.ids.clear()
            self.ends.clear()
        new = [p for p in set(pieces) if p not in self.ids]
        for piece, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False) if new else []):
            self.ids[piece] = np.array(e.ids, np.int32).tobytes()
            self.ends[piece] = np.array([len(piece), *(a for a, _ in e.offsets)], np.int32).tobytes()

    def cut(self, text: str) -> list[str]:
        pieces = self.pieces(text)
        self.learn(pieces)
        return pieces

    def forget(self) -> None:
        """Drop the long pieces, which rarely come again."""
        for piece in [p for p in self.ids if len(p) > KEPT_CHARS]:
            del self.ids[piece], self.ends[piece]

    def encode(self, text: str | None) -> bytes:
        """The ids as int32 bytes; nothing for null and empty text."""
        return b"".join(map(self.ids.__getitem__, self.cut(text))) if text else b""

    def starts(self, text: str | None) -> np.ndarray:
        """For each token the position, in code points, of the character that its first byte belongs to."""
        out, at = [], 0
        for piece in self.cut(text) if text else []:
            n, *begins = np.frombuffer(self.ends[piece], np.int32).tolist()
            out += [at + b for b in begins]
            at += n
        return np.array(out, np.int32)

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) // 4


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def _lists(blobs: list[bytes]) -> pa.ListArray:
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{FOLDER}/byte_bpe_50k.json", offsets: bool = False) -> DataFrame:
    """`key`, `ids` and, with `offsets`, `starts` of every row's text, without special tokens.

    Null and empty texts have an empty list; white space counts as text, special tokens' strings as ordinary text. Rows are
    not shuffled; repeated keys stay repeated rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = part.column(1).to_pylist()
                cols = [part.column(0), _lists([c.encode(t) for t in texts])]
                if offsets:
                    cols.append(_lists([c.starts(t).tobytes() for t in texts]))
                yield pa.RecordBatch.from_arrays(cols, [key, "ids", *(["starts"] * offsets)])
            c.forget()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", starts array<int>" * offsets)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = f"{FOLDER}/byte_bpe_50k.json") -> DataFrame:
    """The columns `keep` and `n_tokens` (int) of the text; 0 for null and empty text. Ids never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            n = pa.array([c.count(t) for t in batch.column(len(keep)).to_pylist()], pa.int32())
            c.forget()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], [*keep, "n_tokens"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, F.col(text)).mapInArrow(run, f"{fields}, n_tokens int")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = f"{FOLDER}/byte_bpe_50k.json") -> DataFrame:
    """`key` and `text` of every row's id list: bytes by the reversed byte table, joined, then read as UTF-8.

    A list that ends within a character gives U+FFFD there; an empty or null list gives the empty text; null ids are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte = {c: b for b, c in enumerate(byte_chars())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
        table |= {a["id"]: a["content"].encode() for a in spec.get("added_tokens", [])}
        for batch in batches:
            texts = [b"".join(table[i] for i in x or () if i is not None).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
