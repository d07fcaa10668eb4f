"""Matrices of MATLAB level-5 files as a data source of Spark: spark.read.format("mat5").load(path).

Rows are (variable, row, column, value, text): the cells of numeric matrices, all of them or, of sparse ones, those stored; the
strings of cell arrays and the lines of character arrays as text. A variable is a partition, found by the tags of the file without
reading the others. The option variables names some of them, joined by commas. Numbers are read as doubles; complex numbers,
structures and objects raise.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "variable string, row long, column long, value double, text string"
# Fixed values of the format: element types of numbers, and classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, CHARACTERS, SPARSE = 1, 4, 5
NUMERIC = range(6, 16)


def _opened(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


class Elements:
    """The elements of a block of bytes, one after another."""

    def __init__(self, data: bytes, order: str):
        self.data, self.order, self.at = data, order, 0

    def __bool__(self) -> bool:
        return self.at + 8 <= len(self.data)

    def next(self) -> tuple[int, bytes]:
        kind, size = struct.unpack_from(self.order + "II", self.data, self.at)
        if kind >> 16:  # a small element: type, size and up to four bytes in eight
            kind, size, start, step = kind & 0xFFFF, kind >> 16, self.at + 4, 8
        else:
            start, step = self.at + 8, 8 + size + (-size % 8 if kind != COMPRESSED else 0)
        self.at += step
        return kind, self.data[start : start + size]

    def numbers(self) -> np.ndarray:
        kind, data = self.next()
        return np.frombuffer(data, self.order + NUMBERS[kind])


def _head(elements: Elements) -> tuple[int, bool, list[int], str]:
    """(class, complex, dimensions, name) of a matrix element's content."""
    flags = int(elements.numbers()[0])
    return flags & 0xFF, bool(flags & 0x800), elements.numbers().tolist(), elements.next()[1].decode("latin-1")


def _string(data: bytes, order: str) -> list[str]:
    """The lines of a character array."""
    elements = Elements(data, order)
    kind, _, shape, _ = _head(elements)
    if kind != CHARACTERS:
        raise ValueError("cell arrays may hold character arrays only")
    if not elements or not shape[0]:
        return [""]
    kind, raw = elements.next()
    text = raw.decode("utf-8") if kind == 16 else "".join(map(chr, np.frombuffer(raw, order + NUMBERS[kind])))
    rows = shape[0]
    return ["".join(text[r::rows]).rstrip() for r in range(rows)]


def cells(data: bytes, order: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray | None, list[str] | None]:
    """(variable, rows, columns, values, texts) of a matrix element's content."""
    elements = Elements(data, order)
    kind, is_complex, shape, name = _head(elements)
    if is_complex or len(shape) != 2:
        raise ValueError(f"{name}: only real matrices of two dimensions are read")
    rows, columns = shape
    if kind == SPARSE:
        ir, jc, values = elements.numbers(), elements.numbers(), elements.numbers()
        n = int(jc[-1])
        return name, ir[:n].astype(np.int64), np.repeat(np.arange(columns), np.diff(jc)), values[:n].astype(float), None
    at = np.arange(rows * columns)
    if kind in NUMERIC:
        return name, at % max(1, rows), at // max(1, rows), elements.numbers().astype(float), None
    if kind == CELL:
        return name, at % max(1, rows), at // max(1, rows), None, ["\n".join(_string(elements.next()[1], order)) for _ in at]
    if kind == CHARACTERS:
        lines = _string(data, order)
        return name, np.arange(len(lines)), np.zeros(len(lines), np.int64), None, lines
    raise ValueError(f"{name}: class {kind} is not read")


@dataclass
class Variable(InputPartition):
    name: str
    offset: int
    order: str


class MatReader(DataSourceReader):
    def __init__(self, path: str, wanted: set[str] | None):
        self.path, self.wanted = path, wanted

    def _element(self, f, offset: int, order: str, most: int | None = None) -> tuple[int, int, bytes]:
        """(type, offset of the next element, content or its first bytes) of the element at offset."""
        f.seek(offset)
        kind, size = struct.unpack(order + "II", f.read(8))
        data = f.read(min(size, most or size))
        if kind == COMPRESSED:
            inner = zlib.decompressobj().decompress(data, most or 0)
            kind, data = struct.unpack_from(order + "I", inner)[0], inner[8:]
        return kind, offset + 8 + size, data

    def partitions(self):
        with _opened(self.path) as f:
            end, start = f.size(), f.read(128)
            if len(start) < 128 or start[126:128] not in (b"IM", b"MI"):
                raise ValueError(f"{self.path} is not a level-5 file")
            order, offset, out = "<" if start[126:128] == b"IM" else ">", 128, []
            while offset + 8 <= end:
                kind, after, data = self._element(f, offset, order, 4096)
                if kind == MATRIX:
                    name = _head(Elements(data, order))[3]
                    if name and (self.wanted is None or name in self.wanted):
                        out.append(Variable(name, offset, order))
                offset = after
        return out or [Variable("", -1, order)]

    def read(self, partition):
        if partition.offset < 0:
            return
        with _opened(self.path) as f:
            name, rows, columns, values, texts = cells(self._element(f, partition.offset, partition.order)[2], partition.order)
        for lo in range(0, len(rows), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            n = len(rows[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(rows[part].astype(np.int64)), pa.array(columns[part].astype(np.int64)), pa.nulls(n, pa.float64()) if values is None else pa.array(values[part]), pa.nulls(n, pa.string()) if texts is None else pa.array(texts[part])],
                ["variable", "row", "column", "value", "text"],
            )


class MatSource(DataSource):
    @classmethod
    def name(cls):
        return "mat5"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        named = self.options.get("variables")
        return MatReader(self.options["path"], set(named.split(",")) if named else None)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(MatSource)
