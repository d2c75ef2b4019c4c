"""Matrices and pickled vectors from files: npy and npz by ranges of rows in tasks, pickles by a reader of plain values only.

A matrix is described once, from its header; each task then opens the file (by pyarrow, so local, hdfs, s3 or gs) and reads
the rows of its own range. A compressed npz member has no places to begin at: one task inflates it, in bounded pieces. A
pickle is one object, so a task reads a whole file of one; a folder of them is read by many.
"""

from __future__ import annotations

import ast
import io
import pickle
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a matrix that a task reads, and that it holds at once.
RANGE_BYTES, PIECE_BYTES = 64 << 20, 4 << 20
#: What a pickle may name: numpy's arrays and numbers and what they are made by. Everything else is refused.
PLAIN = {
    "numpy": {"ndarray", "dtype", "float32", "float64", "int32", "int64"}, "collections": {"OrderedDict"}, "_codecs": {"encode"},
    "numpy.core.multiarray": {"_reconstruct", "scalar"}, "numpy._core.multiarray": {"_reconstruct", "scalar"},
    "numpy.core.numeric": {"_frombuffer"}, "numpy._core.numeric": {"_frombuffer"},
}


def _opened(path: str):
    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inside)


def _header(f) -> tuple[np.dtype, tuple[int, ...], int]:
    """(dtype, shape, bytes of the header) of an npy stream at its start; objects and order by columns are refused."""
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    kind, size = ("<H", 2) if magic[6] == 1 else ("<I", 4)
    n = struct.unpack(kind, f.read(size))[0]
    known = ast.literal_eval(f.read(n).decode("latin1"))
    dtype = np.dtype(known["descr"])
    if dtype.hasobject or (known["fortran_order"] and len(known["shape"]) > 1):
        raise ValueError("a matrix of objects, or stored by columns, is not read")
    return dtype, known["shape"], 8 + size + n


def _described(path: str, member: str) -> tuple[np.dtype, tuple[int, ...], int, bool]:
    """(dtype, shape, where the rows begin, whether they are compressed) of an npy file or of a member of an npz file."""
    with _opened(path) as f:
        if path.endswith(".npy"):
            return *_header(f), False
        with zipfile.ZipFile(f) as z:
            info = z.getinfo(f"{member}.npy")
            with z.open(info) as inside:
                dtype, shape, head = _header(inside)
        f.seek(info.header_offset + 26)
        name, extra = struct.unpack("<HH", f.read(4))
        return dtype, shape, info.header_offset + 30 + name + extra + head, info.compress_type != zipfile.ZIP_STORED


def read_matrix(spark: SparkSession, path: str, member: str = "arr_0", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(idx, row) of a matrix of numbers in an npy file or a member of an npz file; a vector counts as rows of one."""
    dtype, shape, begin, packed = _described(path, member)
    rows, width = shape[0], int(np.prod(shape[1:], dtype=np.int64))
    stride = max(1, dtype.itemsize * width)
    step = rows if packed else max(1, range_bytes // stride)
    piece, parts = max(1, PIECE_BYTES // stride), -(-rows // max(step, 1))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (n for one in batches for n in one.column(0).to_pylist()):
            at, end = number * step, min(rows, (number + 1) * step)
            with _opened(path) as raw:
                archive = zipfile.ZipFile(raw) if packed else None
                f = archive.open(f"{member}.npy") if archive else raw
                if archive:
                    _header(f)
                else:
                    f.seek(begin + at * stride)
                while at < end:
                    n = min(piece, end - at)
                    values = np.frombuffer(f.read(n * dtype.itemsize * width), dtype).astype(np.float64)
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(ends, pa.array(values))], ["idx", "row"])
                    at += n

    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(kernel, "idx long, row array<double>")


class _Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if name not in PLAIN.get(module, ()):
            raise pickle.UnpicklingError(f"{module}.{name} is not read from a pickle")
        return super().find_class(module, name)


def read_pickled_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, emb) of pickled dicts from name to vector, a file or a folder of them; any other content is an error."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c for one in batches for c in one.column(0).to_pylist()):
            found = _Plain(io.BytesIO(content)).load()
            if not isinstance(found, dict):
                raise pickle.UnpicklingError("the pickle is no dict from name to vector")
            names = list(found)
            for a in range(0, len(names), 1024):
                some = names[a : a + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([str(n) for n in some]), pa.array([np.asarray(found[n], np.float64).ravel() for n in some], pa.list_(pa.float64()))], ["name", "emb"])

    return spark.read.format("binaryFile").load(path).select(F.col("content")).mapInArrow(kernel, "name string, emb array<double>")
