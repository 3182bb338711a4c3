"""FITS binary tables, plain or compressed by tiles, and a data source of light curves that reads them file by file."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Element types of columns by the letter of their format.
KINDS = {"D": ">f8", "E": ">f4", "K": ">i8", "J": ">i4", "I": ">i2", "B": "u1", "L": "S1", "A": "S1"}
#: Fixed values of the Rice code by bytes of a value: bits of a block's code, the code of unpacked blocks, bits of a value.
RICE = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}
BLOCK, CARD = 2880, 80


def value(text: str) -> object:
    """What the text behind a card's equals sign says: a string, a truth value, a number or None."""
    text = text.strip()
    if text.startswith("'"):
        return text[1:].split("'")[0].strip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return float(text.replace("D", "E")) if set(text) & set(".ED") else int(text)
    except ValueError:
        return None


def units(raw: bytes) -> Iterator[tuple[dict[str, object], int, int]]:
    """Header, start and size of the data of each unit."""
    at = 0
    while at < len(raw):
        own: dict[str, object] = {}
        ended = False
        while not ended and at < len(raw):
            block = raw[at : at + BLOCK].decode("ascii", "replace")
            at += BLOCK
            for card in (block[i : i + CARD] for i in range(0, BLOCK, CARD)):
                if card.startswith("END"):
                    ended = True
                    break
                if card[8:10] == "= ":
                    own[card[:8].strip()] = value(card[10:])
        axes = [int(own.get(f"NAXIS{i}") or 0) for i in range(1, int(own.get("NAXIS") or 0) + 1)]
        size = abs(int(own.get("BITPIX") or 8)) // 8 * int(np.prod(axes)) if axes else 0
        size += int(own.get("PCOUNT") or 0) if own.get("XTENSION") else 0
        yield own, at, size
        at += -(-size // BLOCK) * BLOCK


def layout(formats: list[str]) -> list[tuple[str, int]]:
    """Element type and count of each column's format; a descriptor of a heap array is two numbers."""
    out = []
    for f in formats:
        digits = len(f) - len(f.lstrip("0123456789"))
        n, letter = int(f[:digits] or 1), f[digits : digits + 1]
        out.append((">i4" if letter == "P" else ">i8", 2 * n) if letter in "PQ" else ("u1", -(-n // 8)) if letter == "X" else (KINDS[letter], n))
    return out


def rice(data: bytes, n: int, size: int, block: int = 32) -> np.ndarray:
    """``n`` whole numbers of ``size`` bytes: the first as it is, then differences in blocks of a code each."""
    bits, unpacked, wide = RICE[size]
    text, at = format(int.from_bytes(data, "big"), f"0{8 * len(data)}b") if data else "", 0

    def take(k: int) -> int:
        nonlocal at
        at += k
        return int(text[at - k : at], 2) if k else 0

    out: list[int] = []
    last, mask, half = take(wide) if n else 0, (1 << wide) - 1, 1 << wide - 1
    while len(out) < n:
        code = take(bits) - 1
        for _ in range(min(block, n - len(out))):
            if code < 0:
                d = 0
            elif code == unpacked:
                d = take(wide)
            else:  # as many zeros as the upper part says, a one, and the lower bits
                one = text.index("1", at)
                zeros, at = one - at, one + 1
                d = zeros << code | take(code)
            last = last + (~(d >> 1) if d & 1 else d >> 1) & mask
            out.append(last)
    x = np.array(out, np.int64)
    return (x if size == 1 else np.where(x >= half, x - (1 << wide), x)).astype(f">i{size}" if size > 1 else "u1")


def tile(data: bytes, how: str, kind: np.dtype, n: int) -> np.ndarray:
    """``n`` values of one column of one tile."""
    if how == "RICE_1":
        return rice(data, n, kind.itemsize)
    raw = data if how == "NOCOMPRESS" else gzip.decompress(data)
    if how == "GZIP_2":  # first bytes of all values, then second ones, and so on
        raw = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.tobytes()
    elif how not in ("GZIP_1", "NOCOMPRESS"):
        raise ValueError(f"unknown compression {how}")
    return np.frombuffer(raw, kind, n)


def expanded(own: dict[str, object], raw: bytes, at: int) -> dict[str, np.ndarray]:
    """The columns of a table that is compressed by tiles of rows: each row of it is a tile, each column an array in the heap."""
    n_tiles, rows, per, n = int(own["NAXIS2"]), int(own["ZNAXIS2"]), int(own["ZTILELEN"]), int(own["TFIELDS"])
    heads = np.dtype([(str(i), kind, count) for i, (kind, count) in enumerate(layout([str(own[f"TFORM{i}"]) for i in range(1, n + 1)]))])
    table = np.frombuffer(raw, heads, n_tiles, at)
    heap = at + int(own.get("THEAP") or int(own["NAXIS1"]) * n_tiles)
    out = {}
    for i, (kind, count) in enumerate(layout([str(own[f"ZFORM{i}"]) for i in range(1, n + 1)])):
        parts = []
        for k in range(n_tiles):
            length, offset = (int(x) for x in table[str(i)][k])
            many = min(per, rows - k * per) * count
            parts.append(tile(raw[heap + offset : heap + offset + length], str(own.get(f"ZCTYP{i + 1}") or "GZIP_2"), np.dtype(kind), many))
        x = np.concatenate(parts) if parts else np.zeros(0, kind)
        out[str(own[f"TTYPE{i + 1}"])] = x.reshape(rows, count) if count > 1 else x
    return out


def decoded(raw: bytes) -> tuple[dict[str, object], dict[str, np.ndarray]]:
    """Header values of all units, earlier ones first, and the columns of the first binary table."""
    header: dict[str, object] = {}
    columns: dict[str, np.ndarray] = {}
    for own, at, _ in units(raw):
        header |= {k: v for k, v in own.items() if k not in header}
        if own.get("XTENSION") == "BINTABLE" and not columns:
            if own.get("ZTABLE"):
                columns = expanded(own, raw, at)
                continue
            kinds = layout([str(own[f"TFORM{i}"]) for i in range(1, int(own["TFIELDS"]) + 1)])
            row = np.dtype([(str(own[f"TTYPE{i + 1}"]), kind, count) if count > 1 else (str(own[f"TTYPE{i + 1}"]), kind) for i, (kind, count) in enumerate(kinds)])
            table = np.frombuffer(raw, row, int(own["NAXIS2"]), at)
            columns = {name: table[name] for name in row.names}
    return header, columns


class FitsCurves(DataSource):
    """``spark.read.format("fits_curves").load(path)``: light curves of one file, or of all under a folder, a partition each.

    Options: ``flux`` names the flux column (PDCSAP_FLUX by default), ``columns`` a
    comma-separated choice of result columns: others are not made.  A broken file
    gives one row with its error.  Files are listed and read through Arrow's file
    systems; ``files.read_fits`` reads what only Spark's readers can open.
    """

    @classmethod
    def name(cls) -> str:
        return "fits_curves"

    def schema(self) -> str:
        from starfold.sources.files import FITS

        known = dict(f.strip().split() for f in FITS.split(","))
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return ", ".join(f"{c} {known[c]}" for c in wanted or known)

    def reader(self, schema: StructType) -> DataSourceReader:
        return FitsReader(self.options.get("path", ""), self.options.get("flux", "PDCSAP_FLUX"), schema)


class FitsReader(DataSourceReader):
    def __init__(self, path: str, flux: str, schema: StructType):
        self.path, self.flux, self.names = path, flux, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [InputPartition(root)]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.lower().endswith(ENDS)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        from starfold.sources.files import curve_of

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        with system.open_input_stream(partition.value) as f:
            raw = f.read()
        yield pa.RecordBatch.from_pandas(curve_of(partition.value, raw, self.flux)[self.names], preserve_index=False, schema=arrow_schema(self.names))


#: How names of FITS files end.
ENDS = (".fits", ".fit", ".fz", ".fits.gz", ".fit.gz")


def arrow_schema(names: list[str]) -> pa.Schema:
    from starfold.sources.files import FITS

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32()}
    known = dict(f.strip().split() for f in FITS.split(","))
    return pa.schema([(n, kinds[known[n]]) for n in names])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FitsCurves)
