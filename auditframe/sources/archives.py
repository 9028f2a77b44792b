"""Array archives as a data source, and archives of checkpoints.

``spark.read.format("arrays")`` lists the arrays of ``.npz`` and ``.safetensors`` files: name, type and shape come from headers that are read
by byte range, so a file of gigabytes costs a few kilobytes. With the option ``tensors`` the values come along. Each file is a
partition of its own. A file that can't be read is a row with an ``error``, not a failed job.

Paths are those that pyarrow's file systems open: local or shared folders, ``hdfs://`` and the like.
"""

from __future__ import annotations

import ast
import hashlib
import io
import json
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auditframe.sources.tables import replace_table

HEADERS = "path string, member string, dtype string, shape array<long>, text string, bytes_read long, error string"
#: A scalar text member, such as metadata, is read along with the headers up to this size.
MOST_TEXT = 1 << 20
#: Types of the header format with names of their own.
SAFE_TYPES = {"F64": "float64", "F32": "float32", "F16": "float16", "I64": "int64", "I32": "int32", "I16": "int16", "I8": "int8", "U8": "uint8", "BOOL": "bool"}


class Counted(io.RawIOBase):
    """A seekable file that counts the bytes it hands out."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.count = file, size, 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(max(0, self.size - self.at) if n is None or n < 0 else n)
        self.at += len(data)
        self.count += len(data)
        return data


def opened(path: str):
    """A file system and a path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def array_header(handle) -> tuple[str, list[int], bool]:
    """Type, shape and order (True for columns first) from the start of a single array's file."""
    magic = handle.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("no array header")
    size = struct.unpack("<H", handle.read(2))[0] if magic[6] == 1 else struct.unpack("<I", handle.read(4))[0]
    described = ast.literal_eval(handle.read(size).decode("latin1" if magic[6] < 3 else "utf-8"))
    return described["descr"], list(described["shape"]), described["fortran_order"]


def zipped_arrays(file, tensors: bool) -> Iterator[tuple]:
    """Member, type, shape, text and values of an archive's arrays."""
    with zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if not info.filename.endswith(".npy"):
                continue
            name = info.filename.removesuffix(".npy")
            with archive.open(info) as handle:
                kind, shape, _ = array_header(handle)
            if "O" in kind:
                yield name, kind, shape, None, None, "objects are not read"
                continue
            dtype = np.dtype(kind)
            text = values = None
            if dtype.kind in "US" and shape == [] and info.file_size <= MOST_TEXT:
                text = np.load(io.BytesIO(archive.read(info)), allow_pickle=False).item()
                text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
            elif tensors and dtype.kind in "fiub":
                values = np.load(io.BytesIO(archive.read(info)), allow_pickle=False).ravel().astype(float).tolist()
            yield name, dtype.name if dtype.kind not in "US" else "text", shape, text, values, None


def safe_arrays(file, tensors: bool) -> Iterator[tuple]:
    size = struct.unpack("<Q", file.read(8))[0]
    if size > file.size - 8:
        raise ValueError("header is longer than the file")
    for name, own in json.loads(file.read(size)).items():
        if name == "__metadata__":
            yield name, "text", [], json.dumps(own, sort_keys=True), None, None
            continue
        kind, (begin, end), values = SAFE_TYPES.get(own["dtype"]), own["data_offsets"], None
        wrong = None if kind is None or np.dtype(kind).itemsize * int(np.prod(own["shape"], dtype=np.int64)) == end - begin and 8 + size + end <= file.size else "size"
        if tensors and kind and not wrong:
            file.seek(8 + size + begin)
            values = np.frombuffer(file.read(end - begin), dtype=np.dtype(kind).newbyteorder("<")).astype(float).tolist()
        yield name, kind or own["dtype"], own["shape"], None, values, wrong


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _ArrayReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, inner = opened(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no such path: {self.path}")
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        names = sorted(f.path for f in found if f.is_file and f.path.endswith((".npz", ".safetensors")))
        return [_File(prefix + n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tensors = "values" in self.columns
        system, inner = opened(partition.path)
        rows, count = [], 0
        try:
            with system.open_input_file(inner) as raw:
                file = Counted(raw, raw.size())
                rows = list((zipped_arrays if inner.endswith(".npz") else safe_arrays)(file, tensors))
                count = file.count
        except Exception as error:  # noqa: BLE001  any broken file is reported as a row
            rows = [(None, None, None, None, None, f"{type(error).__name__}: {error}"[:200])]
        for member, dtype, shape, text, values, wrong in rows:
            own = {"path": partition.path, "member": member, "dtype": dtype, "shape": shape, "text": text, "values": values, "bytes_read": count, "error": wrong}
            yield tuple(own[c] for c in self.columns)


class ArrayArchives(DataSource):
    """The arrays of archives, one row each; a given schema of some of the columns reads no more than those need."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return HEADERS + (", values array<double>" if self.options.get("tensors", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _ArrayReader(self.options["path"], [f.name for f in schema])


def read_arrays(spark: SparkSession, path: str, tensors: bool = False) -> DataFrame:
    spark.dataSource.register(ArrayArchives)
    return spark.read.format("arrays").option("tensors", str(tensors).lower()).load(path)


def model_outputs(arrays: DataFrame, catalog: DataFrame, unit: str, length: str, single: int = 384, pair: int = 128) -> DataFrame:
    """``unit``, ``has_single``, ``has_pair`` and ``why`` an output is wrong (null if it is not), for the entries of ``catalog``.

    A file's name without suffix is its entry's id. It holds ``single_embeddings`` of [length, ``single``], ``pair_embeddings`` of
    [length, length, ``pair``], or both.
    """
    entry = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    shape = lambda name: F.max(F.when(F.col("member") == name, F.col("shape")))
    own = arrays.groupBy(entry.alias("__entry")).agg(shape("single_embeddings").alias("__single"), shape("pair_embeddings").alias("__pair"), F.max("error").alias("__error"))
    n = F.col(length).cast("long")
    why = F.when(F.col("__entry").isNull(), "no file").when(F.col("__error").isNotNull(), F.concat(F.lit("broken: "), "__error"))
    why = why.when(F.col("__single").isNull() & F.col("__pair").isNull(), "no embeddings")
    why = why.when(F.col("__single") != F.array(n, F.lit(single).cast("long")), "shape of single").when(F.col("__pair") != F.array(n, n, F.lit(pair).cast("long")), "shape of pair")
    joined = catalog.select(unit, length).join(own, F.col(unit).cast("string") == F.col("__entry"), "left")
    return joined.select(unit, F.col("__single").isNotNull().alias("has_single"), F.col("__pair").isNotNull().alias("has_pair"), why.alias("why"))


MEMBERS = "archive string, size long, sha256 string, name string, digest string, dtype string, shape array<long>, metadata string, data binary, error string"


def archive_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of compressed tar archives, one after another as they are unpacked; an archive that breaks off ends in a row with an error."""
    names = [c.split()[0] for c in MEMBERS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            archive, size, digest = path.rsplit("/", 1)[-1], len(content), hashlib.sha256(content).hexdigest()
            empty = (archive, size, digest, None, None, None, None, None, None, None)
            try:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as bundle:
                    for member in bundle:
                        if not (member.isfile() and member.name.startswith("embeddings/") and member.name.endswith(".npz")):
                            continue
                        name = member.name.rsplit("/", 1)[-1].removesuffix(".npz")
                        try:
                            with np.load(io.BytesIO(bundle.extractfile(member).read()), allow_pickle=False) as values:
                                single, metadata = values["single"], str(values["metadata"].item())
                            wrong = None if np.isfinite(single).all() else "not finite"
                            row = (archive, size, digest, member.name, name, single.dtype.name, list(single.shape), metadata, single.astype(single.dtype.newbyteorder("<")).tobytes(), wrong)
                        except (ValueError, KeyError, OSError, zipfile.BadZipFile) as error:
                            row = (archive, size, digest, member.name, name, None, None, None, None, f"unreadable: {error}"[:200])
                        yield pd.DataFrame([row], columns=names)
                yield pd.DataFrame([empty], columns=names)  # so that an archive without members is known, too
            except (tarfile.TarError, EOFError, OSError) as error:
                yield pd.DataFrame([(*empty[:-1], f"broken off: {error}"[:200])], columns=names)


SIDECAR = "archive_sha256 string, size long, embedding_width int, sequence_sha256 array<string>"


def checkpoint_problems(members: DataFrame, sidecars: DataFrame, catalog: DataFrame, width: int) -> DataFrame:
    """``archive``, ``digest`` and ``why`` for all that is wrong: archives against their sidecars, members against the
    sidecars' lists, lists against one another and the catalog, arrays against the sequences' lengths."""

    def rows(df: DataFrame, why: str, digest=None) -> DataFrame:
        return df.select("archive", (digest if digest is not None else F.lit(None).cast("string")).alias("digest"), F.lit(why).alias("why"))

    archives = members.groupBy("archive").agg(F.max("size").alias("size"), F.max("sha256").alias("sha256"))
    both = archives.join(sidecars.withColumnRenamed("size", "told"), "archive", "full")
    listed = sidecars.select("archive", F.explode("sequence_sha256").alias("digest"))
    held = members.where("digest IS NOT NULL")
    lengths = catalog.select(F.col("sequence_sha256").alias("digest"), F.col("sequence_length").cast("long").alias("length"))
    shaped = held.where("error IS NULL").join(lengths, "digest").where(~F.col("shape").eqNullSafe(F.array(F.col("length"), F.lit(width).cast("long"))))
    twice = listed.groupBy("digest").agg(F.count("*").alias("n"), F.max("archive").alias("archive")).where("n > 1")
    found = [
        members.where("error IS NOT NULL").select("archive", "digest", F.col("error").alias("why")),
        rows(both.where(F.col("embedding_width").isNull()), "no usable sidecar"), rows(both.where(F.col("sha256").isNull()), "no archive"),
        rows(both.where((F.col("told") != F.col("size")) | (F.col("archive_sha256") != F.col("sha256"))), "digest or size"), rows(both.where(F.col("embedding_width") != width), "width"),
        rows(both.where(F.size(F.array_distinct("sequence_sha256")) < F.greatest(F.size("sequence_sha256"), F.lit(1))), "list"),
        rows(listed.join(held, ["archive", "digest"], "left_anti"), "listed, not held", F.col("digest")), rows(held.join(listed, ["archive", "digest"], "left_anti"), "held, not listed", F.col("digest")),
        rows(twice, "listed twice", F.col("digest")), rows(listed.join(lengths, "digest", "left_anti"), "not in the catalog", F.col("digest")), rows(shaped, "shape", F.col("digest")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def import_checkpoints(spark: SparkSession, folder: str, catalog: DataFrame, target: str, width: int) -> int:
    """Put all members of the archives ``embedding_*.tar.gz`` of ``folder`` into the table ``target``, or none: any problem is an error that names the first
    of them. Each archive has a sidecar of its name with ``.json``. The table is swapped in whole at the end; its rows are counted."""
    read = spark.read.format("binaryFile")
    archives = read.option("pathGlobFilter", "embedding_*.tar.gz").load(folder).select("path", "content")
    members = archives.mapInPandas(archive_members, MEMBERS)
    side = read.option("pathGlobFilter", "embedding_*.json").load(folder)
    told = F.from_json(F.col("content").cast("string"), SIDECAR)
    sidecars = side.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", ".tar.gz").alias("archive"), told.alias("s")).select("archive", "s.*").where("archive_sha256 IS NOT NULL AND size IS NOT NULL AND sequence_sha256 IS NOT NULL AND embedding_width IS NOT NULL")
    wrong = checkpoint_problems(members.drop("data"), sidecars, catalog, width).limit(20).collect()
    if wrong:
        raise ValueError("; ".join(sorted(f"{r.archive}: {r.why}" + (f" ({r.digest[:12]})" if r.digest else "") for r in wrong)))
    ids = catalog.select(F.col("sequence_sha256").alias("digest"), "protein_id")
    held = members.where("digest IS NOT NULL").join(ids, "digest")
    replace_table(held.select("protein_id", F.col("digest").alias("sequence_sha256"), "archive", "dtype", "shape", "metadata", "data"), target)
    return spark.read.parquet(target).count()
