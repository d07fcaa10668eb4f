"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last characters has a fixed pattern, so passages that documents share give the same
chunks wherever they stand. A worker encodes a chunk once and keeps the tokens between its first and its last certain word start.
Chunks are joined by encoding the text around each join again, between certain word starts of both sides, where old and new
tokens agree exactly. No chunk is shuffled and the kept chunks are bounded, so memory doesn't depend on the input.

Edge cases: null text counts as empty (no tokens, the hash of nothing); the end-of-text marker inside a text is one token, as
the library reads it; repeated rows give repeated results, and ties don't arise; a very long text costs time and memory in
proportion to its length; an empty table gives an empty result; other columns, of any name, are ignored, except in
encode_documents, which returns them.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import OrderedDict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import tidied

#: A chunk ends where the low bits of the rolling hash are all ones; about 1 in 512 bytes.
MASK = np.uint32(0x1FF << 13)
WINDOW, LEAST, MOST = 16, 64, 4096
#: Characters of the chunks that a worker keeps.
KEPT = 4_000_000
#: Characters of a run of white space that the splitting pattern doesn't get to see whole; more than a chunk has.
LONG_RUN = 10_000
#: Fixed value: the characters that the splitting pattern takes for white space.
_long_run = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
_gear = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file, through reused chunks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # Fixed value: the splitting pattern of byte-level vocabularies.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.library = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.table = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.kept: OrderedDict[str, tuple] = OrderedDict()
        self.size = 0
        self.reused = 0

    def plain(self, text: str) -> list[int]:
        """Tokens of a text in one piece.

        The pattern would go too deep on a run of white space of a million characters. All of a run but its last character are one
        word of the pattern, or all of it at the end of the text, so long runs are cut out and merged as that word.
        """
        if len(text) < LONG_RUN:
            return self.library.encode_ordinary(text)
        out: list[int] = []
        done = 0
        for m in _long_run.finditer(text):
            lo, hi = m.span()
            hi -= hi < len(text)
            out += self.library.encode_ordinary(text[done:lo])
            out += self.library._encode_single_piece(text[lo:hi])
            done = hi
        return out + self.library.encode_ordinary(text[done:])

    def chunk(self, text: str) -> tuple[array, int, int]:
        """(tokens, head, tail) of a chunk: those of text[head:tail]; what lies outside is left to the joins.

        head and tail are spaces after something that isn't white space. No word of the splitting pattern goes on from there
        into a space, so a word starts at both in every text that holds the chunk, and tokens on either side don't depend on
        each other.
        """
        got = self.kept.get(text)
        if got is not None:
            self.kept.move_to_end(text)
            self.reused += 1
            return got
        head, tail = text.find(" ", 1), text.rfind(" ")
        while 0 < head < tail and text[head - 1].isspace():
            head = text.find(" ", head + 1)
        while 0 < head < tail and text[tail - 1].isspace():
            tail = text.rfind(" ", 0, tail)
        # Packed: a list of Python numbers would take several times the room.
        got = (array("i", self.plain(text[head:tail])), head, tail) if 0 < head < tail else (array("i"), 0, 0)
        self.kept[text] = got
        self.size += len(text)
        while self.size > KEPT:
            old, _ = self.kept.popitem(last=False)
            self.size -= len(old)
        return got

    def segment(self, text: str) -> list[int]:
        """Tokens of a text without special tokens."""
        if len(text) < 2 * LEAST:
            return self.plain(text)
        out: list[int] = []
        done = at = 0  # the tokens of text[:done] are final
        for piece in chunks(text):
            tokens, head, tail = self.chunk(piece)
            if tail > head:
                # The join: what lies between two certain word starts is encoded again.
                out += self.plain(text[done : at + head])
                out += tokens
                done = at + tail
            at += len(piece)
        return out + self.plain(text[done:])

    def encode(self, text: str) -> list[int]:
        if not self.split or not any(x in text for x in self.special):
            return self.segment(text)
        out: list[int] = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self.segment(part)
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.table
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def chunks(text: str) -> list[str]:
    """text cut where the rolling hash of the last WINDOW characters' low bytes says so; pieces of LEAST to MOST characters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _gear[code & 255]
    k = 1
    while k < WINDOW:  # h[i] becomes the sum of gear << age over the last WINDOW characters, by doubling
        h[k:] += h[:-k].copy() << np.uint32(k)
        k *= 2
    ends = np.nonzero((h & MASK) == MASK)[0] + 1
    out, lo = [], 0
    for e in ends.tolist():
        if e - lo < LEAST:
            continue
        while e - lo > MOST:
            out.append(text[lo : lo + MOST])
            lo += MOST
        if e > lo:
            out.append(text[lo:e])
            lo = e
    while lo < len(text):
        out.append(text[lo : lo + MOST])
        lo += MOST
    return out


def default_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def _digest_batches(batches, path):
    return tidied(_digests(batches, path))


def _digests(batches, path):
    c = Codec(path)  # of this task: a worker that other stages use again keeps neither tables nor chunks
    for batch in batches:
        n, ids_hash, text_hash = [], [], []
        for x in batch.column(1):
            ids = c.encode(x.as_py() or "")
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(partial(_digest_batches, path=path or default_path()), kinds)


def _id_batches(batches, path, at):
    return tidied(_ids(batches, path, at))


def _ids(batches, path, at):
    c = Codec(path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):  # few texts at once: their tokens are Python numbers until packed
            part = batch.slice(lo, 128)
            ids = []
            for x in part.column(at):
                text = x.as_py() or ""
                ids.append(np.array(c.encode(text), np.int32))
                if c.decode(ids[-1].tolist()) != text:
                    raise ValueError("a text did not come back from its tokens")
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, "token_ids"]
            )


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with token_ids array<int>; every text is decoded again and compared. A column of that name is replaced."""
    rows = docs.drop("token_ids")
    # Columns go through Python by number, so that their names may be anything.
    names, numbered = rows.columns, rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))
    schema = StructType([*numbered.schema.fields, StructField("token_ids", ArrayType(IntegerType()))])
    coded = numbered.mapInArrow(partial(_id_batches, path=path or default_path(), at=names.index("text")), schema)
    return coded.toDF(*names, "token_ids")
