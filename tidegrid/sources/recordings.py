"""Recordings as Spark tables: a data source whose partitions are stretches of samples, and descriptions of many files at once.

    register(spark)
    spark.read.format("recording").load("/shared/take.sigmf-meta")

gives n, i, q (q is null for real samples). Options: datatype for files without a
header, chunk (samples of a partition), swap_iq, member (the place in an archive),
offset and length (one region of the file, in bytes, in place of what its header says).
Filters on n leave out whole partitions. Files are reached by their address
through pyarrow's file systems, so the folder has to be one that all executors see.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import containers, formats
from .containers import BadHeader, Recording

CHUNK = 1 << 20
SCHEMA = "n long, i double, q double"
#: The datatypes that recorders' file extensions stand for.
EXTENSIONS = {".cu8": "cu8", ".cs8": "ci8", ".sc8": "ci8", ".cs16": "ci16_le", ".sc16": "ci16_le", ".cf32": "cf32_le", ".fc32": "cf32_le", ".cfile": "cf32_le"}


def files_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def opened(path: str, datatype: str | None = None) -> list[Recording]:
    """The recordings of a file. A raw file is read as the datatype given or the one of its extension."""
    files, at = files_of(path)
    name = at.rsplit("/", 1)[-1]
    if name.lower().endswith(".sigmf-data"):
        path, at = path[: -len("data")] + "meta", at[: -len("data")] + "meta"
    with files.open_input_file(at) as f:
        size, read = f.size(), lambda offset, n: f.read_at(n, offset)
        kind = containers.kind_of(read(0, min(40, size)), name)
        if kind == "compressed":
            raise BadHeader(f"{name} is compressed; samples need random access")
        if kind == "SigMF":
            data = at[: -len("meta")] + "data"
            got = containers.sigmf(read(0, size), files.get_file_info(data).size or 0, name)
            got.file = path[: -len("meta")] + "data"
            return [got]
        if kind == "SigMF archive":
            return containers.sigmf_archive(read, size)
        if kind == "raw":
            datatype = datatype or EXTENSIONS.get("." + name.lower().rsplit(".", 1)[-1])
            width = formats.parse(datatype).sample_bytes if datatype else 1
            return [Recording("raw", name, datatype, [(0, size - size % width)])]
        got = {"WAV": containers.wav, "array": containers.npy, "sdriq": containers.sdriq, "Blue": containers.blue, "VITA 49": containers.vita49}[kind](read, size, name)
        if got.file:
            got.file = path.rsplit("/", 1)[0] + "/" + got.file
        if datatype:
            got.datatype = datatype
        return [got]


@dataclass
class Stretch(InputPartition):
    """Samples first to first + count - 1 of a recording, as pieces (offset, length) of a file."""

    path: str
    datatype: str
    first: int
    pieces: list[tuple[int, int]]
    swap_iq: bool


def stretches(recording: Recording, path: str, chunk: int, swap_iq: bool = False, low: int = 0, high: int | None = None) -> list[Stretch]:
    """Partitions of at most chunk samples that may hold samples low to high; pieces of short segments share one."""
    if recording.datatype is None:
        raise BadHeader("the datatype is not known: give it as an option")
    width, out, n, held, start = formats.parse(recording.datatype).sample_bytes, [], 0, [], 0

    def close() -> None:
        nonlocal held, start
        if held and n > low and (high is None or start <= high):
            out.append(Stretch(recording.file or path, recording.datatype, start, held, swap_iq))
        held, start = [], n

    for offset, length in recording.segments:
        samples = length // width
        while samples:
            take = min(samples, chunk - (n - start))
            held.append((offset, take * width))
            offset, samples, n = offset + take * width, samples - take, n + take
            if n - start == chunk:
                close()
    close()
    return out


def region(recording: Recording, path: str, offset: int, length: int | None = None) -> Recording:
    """The recording with one region of its file for its samples: whole samples from a byte on, to the end of the file if no length is given."""
    files, at = files_of(recording.file or path)
    size = files.get_file_info(at).size or 0
    if offset < 0 or offset > size or length is not None and (length < 0 or offset + length > size):
        raise BadHeader(f"the region from {offset} on does not lie in the file's {size} bytes")
    width = formats.parse(recording.datatype).sample_bytes if recording.datatype else 1
    bytes_ = size - offset if length is None else length
    recording.segments = [(offset, bytes_ - bytes_ % width)]
    return recording


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.options = options["path"], options
        self.low, self.high = 0, None

    def pushFilters(self, filters) -> Iterator:
        """Bounds on n choose partitions; Spark still checks each row."""
        for f in filters:
            if getattr(f, "attribute", None) == ("n",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f

    def partitions(self) -> list[Stretch]:
        o = self.options
        found = opened(self.path, o.get("datatype"))[int(o.get("member", 0))]
        if "offset" in o or "length" in o:
            found = region(found, self.path, int(o.get("offset", 0)), int(o["length"]) if "length" in o else None)
        return stretches(found, self.path, int(o.get("chunk", CHUNK)), str(o.get("swap_iq", "false")).lower() == "true", self.low, self.high)

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        kind, n = formats.parse(part.datatype), part.first
        files, at = files_of(part.path)
        with files.open_input_file(at) as f:
            for offset, length in part.pieces:
                for k in range(0, length, step := kind.sample_bytes << 16):
                    i, q = kind.decode(f.read_at(min(step, length - k), offset + k), part.swap_iq)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + len(i))), pa.array(i), pa.nulls(len(i), pa.float64()) if q is None else pa.array(q)], ["n", "i", "q"])
                    n += len(i)


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    samples: int


class RecordingWriter(DataSourceWriter):
    """Writes rows (n, i, q), each partition a file of samples in the order of n, with metadata for all of them."""

    def __init__(self, options: dict):
        self.path, self.datatype, self.rate = options["path"], options.get("datatype", "cf32_le"), options.get("rate")

    def write(self, rows) -> Written:
        import uuid

        kind = formats.parse(self.datatype)
        x = sorted((r[0], r[1], r[2]) for r in rows)
        files, at = files_of(self.path)
        name = f"{uuid.uuid4().hex}.part"
        if x:
            n, i, q = zip(*x)
            files.create_dir(at, recursive=True)
            with files.open_output_stream(f"{at}/{name}") as f:
                f.write(kind.encode(np.array(i), np.array([v or 0.0 for v in q])))
        return Written(name, x[0][0] if x else 0, len(x))

    def commit(self, messages) -> None:
        """Names the parts in order and writes the metadata of each, so that each is a recording of its own."""
        import json

        files, at = files_of(self.path)
        for k, m in enumerate(sorted((m for m in messages if m and m.samples), key=lambda m: m.first)):
            files.move(f"{at}/{m.name}", f"{at}/take_{k:05d}.sigmf-data")
            meta = {"global": {"core:datatype": self.datatype, "core:version": "1.0.0"} | ({"core:sample_rate": float(self.rate)} if self.rate else {}), "captures": [{"core:sample_start": 0}], "annotations": []}
            with files.open_output_stream(f"{at}/take_{k:05d}.sigmf-meta") as f:
                f.write(json.dumps(meta).encode())

    def abort(self, messages) -> None:
        files, at = files_of(self.path)
        for m in messages:
            if m and m.samples:
                files.delete_file(f"{at}/{m.name}")


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters on n handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)


# Many files


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size, modified of a folder's files that can be recordings, without their content; datasets of metadata are left to it."""
    f = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    low = F.lower("name")
    meta = f.where(low.endswith(".sigmf-meta")).select(F.regexp_replace("name", r"(?i)meta$", "data").alias("name"))
    return f.where(~low.rlike(r"\.(json|csv|pdf|txt|md|png|det)$") & ~low.startswith(".")).join(meta, "name", "left_anti").select("path", "name", "size", "modified")


DESCRIBED = "path string, container string, member int, name string, datatype string, samples long, segments int, rate double, frequency double, warnings array<string>, error string"


def described(files: DataFrame) -> DataFrame:
    """A row for each recording of the files (path), from their headers; a file that can't be read has its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    for k, x in enumerate(opened(path)):
                        rows.append((path, x.container, k, x.name, x.datatype, x.samples, len(x.segments), x.rate, x.frequency, x.warnings, None))
                except (ValueError, OSError) as e:
                    rows.append((path, None, None, None, None, None, None, None, None, [], str(e)))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in DESCRIBED.split(", ")])

    return files.select("path").mapInPandas(run, DESCRIBED)


def samples(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, member, n, i, q: the samples of all recordings of a table as described() gives it, in one job; those without a datatype or with an error give none."""
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("samples") - 1) / chunk).cast("long"))
    rows = found.where("error is null and datatype is not null and samples > 0").select("path", "member", F.explode(pieces).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, member, k in zip(*(batch.column(c).to_pylist() for c in ("path", "member", "k"))):
                reader = RecordingReader({"path": path, "member": member, "chunk": chunk})
                reader.low, reader.high = k * chunk, (k + 1) * chunk - 1
                for part in reader.partitions():
                    for own in reader.read(part):
                        here = pa.array(np.zeros(own.num_rows, np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array([path]).take(here), pa.array([member], pa.int32()).take(here), *own.columns], names=["path", "member", "n", "i", "q"])

    return rows.repartition("path", "k").mapInArrow(run, "path string, member int, " + SCHEMA)


# Names


def sequence_number(name: Column) -> Column:
    """The last number in a file's name, its extension aside."""
    return F.regexp_extract(_stem(name), r"(\d+)(?!.*\d)", 1).try_cast("long")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def numbered(files: DataFrame) -> DataFrame:
    """files (name, samples) with series, number, missing (numbers left out before it) and first, the place of its first sample in the series."""
    from pyspark.sql import Window

    f = files.withColumn("number", sequence_number(F.col("name"))).withColumn("series", F.concat(F.regexp_replace(_stem(F.col("name")), r"\d+(?!.*\d)", "#"), F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    w = Window.partitionBy("series").orderBy("number", "name")
    first = F.coalesce(F.sum("samples").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return f.withColumn("missing", F.coalesce(F.col("number") - F.lag("number").over(w) - 1, F.lit(0))).withColumn("first", first)


#: Words and units that say what a number in a name is, and the values that a rate and a frequency can have.
WORDS = {"sample_rate": ("fs", "sr", "srate", "samprate", "samplerate", "rate"), "center_frequency": ("fc", "cf", "freq", "f0", "center", "centre")}
UNITS = {"sample_rate": ("sps", "s/s"), "center_frequency": ("hz",)}
LIMITS = {"sample_rate": (1e3, 1e10), "center_frequency": (1e3, 3e11)}
_NUMBER = r"^([a-z]*?)(\d+(?:\.\d+)?)([kmg]?)([a-z/]*)$"


def scaled(number: Column, unit: Column) -> Column:
    """A number with its k, M or G."""
    return number.cast("double") * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)


def name_hints(files: DataFrame, name: str = "name") -> DataFrame:
    """name, kind, value, scheme: what a file's name says of its rate and frequency, each value once, by the surest scheme.

    A name is cut into parts at _, -, = and blanks. A part that is a number, with or without a unit, is told by the word before it or at its
    start (schemes 1 and 2), else by its unit (3 and 4). In names of six parts as one recorder writes them, place decides (0).
    """
    parts = F.filter(F.split(_stem(F.lower(name)), r"[_\-=\s]+"), lambda p: p != "")
    x = files.select(name, parts.alias("parts")).select(name, F.size("parts").alias("count"), F.col("parts")[0].alias("head"), F.element_at("parts", -1).alias("end"), "parts", F.posexplode("parts").alias("at", "part"))
    part = lambda k: F.regexp_extract("part", _NUMBER, k)
    before = F.when(F.col("at") > 0, F.get("parts", F.col("at") - 1))
    x = x.where(part(2) != "").select(name, "at", scaled(part(2), part(3)).alias("value"), part(4).alias("unit"), F.when(part(1) != "", part(1)).otherwise(before).alias("word"), ((F.col("count") == 6) & (F.col("head") == "gqrx") & (F.col("end") == "fc")).alias("placed"))
    told = F.when(F.col("placed") & (F.col("at") == 3), F.struct(F.lit("center_frequency").alias("kind"), F.lit(0).alias("scheme"))).when(F.col("placed") & (F.col("at") == 4), F.struct(F.lit("sample_rate").alias("kind"), F.lit(0).alias("scheme")))
    for scheme, kind, fits in ((1, "sample_rate", ("", "sps", "ps", "s/s", "hz")), (2, "center_frequency", ("", "hz"))):
        told = told.when(F.col("word").isin(*WORDS[kind]) & F.col("unit").isin(*fits), F.struct(F.lit(kind).alias("kind"), F.lit(scheme).alias("scheme")))
    for scheme, kind in ((3, "sample_rate"), (4, "center_frequency")):
        told = told.when(F.col("unit").isin(*UNITS[kind]), F.struct(F.lit(kind).alias("kind"), F.lit(scheme).alias("scheme")))
    x = x.withColumn("told", told).select(name, "told.kind", "value", "told.scheme")
    allowed = F.lit(False)
    for kind, (low, high) in LIMITS.items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("value").between(low, high))
    return x.where(allowed).groupBy(name, "kind", "value").agg(F.min("scheme").alias("scheme"))


#: Receivers, the datatypes that their recorders write, and their rates.
DEVICES = (
    ("RTL-SDR", ("cu8",), (250e3, 1.024e6, 1.2e6, 1.4e6, 1.8e6, 1.92e6, 2.048e6, 2.4e6, 2.56e6, 2.88e6, 3.2e6)),
    ("HackRF", ("ci8",), (1.75e6, 2e6, 2.5e6, 3.5e6, 4e6, 5e6, 5.5e6, 6e6, 7e6, 8e6, 9e6, 10e6, 12e6, 14e6, 15e6, 16e6, 20e6)),
    ("Airspy", ("ci16_le", "cf32_le"), (2.5e6, 3e6, 6e6, 10e6)),
    ("USRP, PlutoSDR", ("ci16_le", "cf32_le"), (1e6, 2e6, 5e6, 10e6, 20e6, 30.72e6, 61.44e6)),
    ("LTE", (), (1.92e6, 3.84e6, 7.68e6, 15.36e6, 30.72e6)),
    ("sound card", ("ri16_le", "ci16_le", "ri24_le", "ci24_le", "rf32_le", "cf32_le"), (44.1e3, 48e3, 96e3, 192e3)),
)


def rate_candidates(files: DataFrame) -> DataFrame:
    """files (name, datatype) with rate, place and from_name: what the name says first, then rates of receivers whose recorders write the datatype, then the others'."""
    from pyspark.sql import Window

    said = name_hints(files).where(F.col("kind") == "sample_rate").join(files, "name").select("name", "datatype", F.col("value").alias("rate"), F.lit(0).alias("group"), F.col("scheme").alias("k"))
    devices = F.array(*(F.struct(F.array(*map(F.lit, kinds)).cast("array<string>").alias("kinds"), F.lit(float(x)).alias("rate"), F.lit(100 * k + j).alias("k")) for k, (_, kinds, rates) in enumerate(DEVICES) for j, x in enumerate(rates)))
    known = files.select("name", "datatype", F.explode(devices).alias("d")).select("name", "datatype", "d.rate", F.when(F.array_contains("d.kinds", F.col("datatype")), 1).otherwise(2).alias("group"), "d.k")
    best = said.unionByName(known).groupBy("name", "datatype", "rate").agg(F.min(F.struct("group", "k")).alias("x"))
    w = Window.partitionBy("name", "datatype").orderBy("x", "rate")
    return best.select("name", "datatype", "rate", F.row_number().over(w).alias("place"), (F.col("x.group") == 0).alias("from_name"))
