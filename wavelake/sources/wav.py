"""WAV headers and samples: ranged reads by many tasks, and a writer with task and job commit."""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
import wave
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from wavelake.plans.batches import plain
from wavelake.plans.ordered import BLOCK, spread_groups
from wavelake.schema import SAMPLE_RATE, WAV_BLOCKS
from wavelake.session import settled
from wavelake.sources.stores import RangedFile, open_store


class _Bytes:
    """A whole file in memory, read like a `RangedFile`."""

    def __init__(self, content: bytes):
        self.content, self.size = content, len(content)

    def read(self, start: int, length: int) -> bytes:
        return self.content[start : start + length]


def _readable(source):
    return _Bytes(bytes(source)) if isinstance(source, (bytes, bytearray, memoryview)) else source


def wav_layout(source) -> dict:
    """Format fields and the place of the data chunk; raises ValueError for anything that is not usable audio.

    ``source`` is the content of a file or a `RangedFile`, of which only the chunk headers are read.
    """
    source = _readable(source)
    head = source.read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, layout = 12, {}
    while at + 8 <= source.size:
        name, size = struct.unpack("<4sI", source.read(at, 8))
        if name == b"fmt ":
            fields = source.read(at + 8, 28)
            kind, channels, rate, _, frame_bytes, bits = struct.unpack("<HHIIHH", fields[:16])
            if kind == 0xFFFE:
                kind = struct.unpack("<H", fields[24:26])[0]
            layout.update(kind=kind, channels=channels, rate=rate, frame_bytes=frame_bytes, bits=bits)
        elif name == b"data":
            if "kind" not in layout or not layout["frame_bytes"]:
                raise ValueError("data before format")
            stored = min(size, source.size - at - 8)
            layout.update(data=at + 8, frames=stored // layout["frame_bytes"])
            break
        at += 8 + size + size % 2
    if "data" not in layout:
        raise ValueError("no audio data")
    if layout["frames"] == 0:
        raise ValueError("zero frames")
    return layout


def wav_samples(source, layout: dict, start: int, stop: int) -> np.ndarray:
    """Channel mean of the frames [start, stop) as 32-bit floats; no other part of a `RangedFile` is read."""
    width, channels = layout["bits"] // 8, layout["channels"]
    first = layout["data"] + start * layout["frame_bytes"]
    raw = _readable(source).read(first, (stop - start) * layout["frame_bytes"])
    if layout["kind"] == 3:
        values = np.frombuffer(raw, dtype="<f4" if width == 4 else "<f8").astype(np.float64)
    elif layout["kind"] != 1:
        raise ValueError(f"unsupported WAV format {layout['kind']}")
    elif width == 3:
        parts = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) << 8 >> 8) / 8388608.0
    elif width == 1:
        values = (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128) / 128.0
    else:
        values = np.frombuffer(raw, dtype=f"<i{width}") / float(1 << (8 * width - 1))
    return values.reshape(-1, channels).mean(axis=1).astype(np.float32)


_LAYOUT = ["rate", "channels", "frames", "kind", "frame_bytes", "bits", "data"]
_LAYOUTS = "path STRING, " + ", ".join(f"{name} BIGINT" for name in _LAYOUT) + ", error STRING"


def _layouts(files: DataFrame) -> DataFrame:
    """The layout of each file, read from its head; an unusable file becomes an error row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    file = RangedFile(path)
                    try:
                        layout = wav_layout(file)
                    finally:
                        file.close()
                    rows.append((path, *(layout[name] for name in _LAYOUT), None))
                except (ValueError, OSError, struct.error) as error:
                    rows.append((path, *(None for _ in _LAYOUT), str(error)))
            frame = pd.DataFrame(rows, columns=["path", *_LAYOUT, "error"])
            yield plain(frame.astype({name: "Int64" for name in _LAYOUT}))

    return files.select("path").mapInPandas(read, _LAYOUTS)


def probe_wav(files: DataFrame) -> DataFrame:
    """(path) to (path, sample_rate, channels, frames, error); an unusable file becomes an error row.

    ``files`` comes from ``binaryFile`` or a listing; its content is not read. A probe reads the first kilobytes of a
    file, and further chunk headers where the audio begins later. Probe only the paths that are needed: join the plan
    first, then probe.
    """
    found = _layouts(files)
    return found.select(
        "path", F.col("rate").cast("int").alias("sample_rate"), F.col("channels").cast("int").alias("channels"), "frames", "error"
    )


def quarantine(probed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable sources, and the others as (path, error)."""
    return probed.where(F.col("error").isNull()), probed.where(F.col("error").isNotNull()).select("path", "error")


#: Bytes of a file that one task decodes; a longer file is read by several tasks.
RANGE_BYTES = 32 << 20


def read_wav_blocks(
    files: DataFrame, block: int = BLOCK, start: int = 0, stop: int | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Decodes WAV files to mono blocks (path, sample_rate, channels, frames, block, start, samples, error).

    Heads are read first; then every run of blocks of about ``range_bytes`` is a row of its own that is dealt over the
    tasks, which read nothing but these bytes and yield block by block. ``start`` and ``stop`` select frames; nothing
    outside is read. A file or run that cannot be decoded gives one row with its error.
    """
    end = F.col("frames") if stop is None else F.least(F.lit(stop), F.col("frames"))
    first, last = start // block, F.floor((F.col("_end") - 1) / block)
    step = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / (F.col("frame_bytes") * block))).cast("bigint")
    planned = _layouts(files).withColumn("_end", end.cast("bigint")).withColumn("_step", step)
    begins = F.when(F.col("_end") > start, F.sequence(F.lit(first).cast("bigint"), last.cast("bigint"), F.col("_step")))
    runs = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("bigint"))).otherwise(begins)
    planned = planned.withColumn("_first", F.explode(runs))

    def whole(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
        numbers = dict.fromkeys(["sample_rate", "channels", "frames", "block", "start"], "Int64")
        return plain(pd.DataFrame(rows, columns=columns).astype(numbers))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sample_rate", "channels", "frames", "block", "start", "samples", "error"]
        # Short files go on together; a frame holds about one block of samples.
        ready, held = [], 0
        for batch in batches:
            for row in batch.to_dict("records"):
                path, error, file = row["path"], row["error"], None
                try:
                    if error is not None:
                        raise ValueError(error)
                    layout = {name: int(row[name]) for name in _LAYOUT}
                    file = RangedFile(path, 0)
                    for number in range(int(row["_first"]), min(int(row["_first"]) + int(row["_step"]), (int(row["_end"]) - 1) // block + 1)):
                        a, b = max(start, number * block), min(int(row["_end"]), (number + 1) * block)
                        samples = wav_samples(file, layout, a, b)
                        if not np.isfinite(samples).all():
                            raise ValueError("non-finite samples")
                        ready.append((path, layout["rate"], layout["channels"], layout["frames"], number, a, samples, None))
                        held += len(samples)
                        if held >= BLOCK:
                            yield whole(ready, columns)
                            ready, held = [], 0
                except (ValueError, OSError, struct.error) as error:
                    ready.append((path, None, None, None, None, None, None, str(error)))
                finally:
                    if file is not None:
                        file.close()
        if ready:
            yield whole(ready, columns)

    return spread_groups(planned, "path", "_first").mapInPandas(decode, WAV_BLOCKS)


# Bytes of a sample and the largest code of each subtype; FLOAT has no codes and no full scale.
SUBTYPES = {"PCM_16": (2, 32768), "PCM_24": (3, 8388608), "FLOAT": (4, None)}


def wav_head(frames: int, width: int, rate: int, kind: int = 1) -> bytes:
    """The 44 bytes before the samples of a mono file; kind 1 holds codes, 3 floats."""
    size = frames * width
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, kind, 1, rate, rate * width, width, 8 * width)
    return struct.pack("<4sI4s", b"RIFF", 36 + size, b"WAVE") + form + struct.pack("<4sI", b"data", size)


def wav_codes(samples, width: int, scale: int | None) -> bytes:
    if scale is None:
        return np.asarray(samples, dtype="<f4").tobytes()
    codes = np.clip(np.rint(np.asarray(samples, dtype=np.float64) * scale), -scale, scale - 1).astype("<i4")
    return codes.astype("<i2").tobytes() if width == 2 else codes.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its staging folder and the files in it."""

    staging: str
    files: list[tuple[str, int]]


class WavWriter(DataSourceArrowWriter):
    """Writes files into a staging folder of the task; the job moves them to their names when all tasks are done.

    Rows (path, frames, samples) come with the blocks of a path together and in order. A task that fails or runs twice
    leaves nothing under the final names, and an aborted job removes its staging folder.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.job = options["path"].rstrip("/"), f"_job-{uuid.uuid4().hex}"
        self.width, self.scale = SUBTYPES[options.get("subtype", "PCM_16")]
        self.rate = int(options.get("rate", SAMPLE_RATE))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top, _ = open_store(self.folder)
        staging = f"{self.job}/{uuid.uuid4().hex}"
        files: list[tuple[str, int]] = []
        current, out, left = None, None, 0
        try:
            for batch in iterator:
                for path, frames, samples in zip(*(batch.column(c).to_pylist() for c in ("path", "frames", "samples"))):
                    if path != current:
                        if out:
                            out.close()
                        current, left, name = path, frames, f"{top}/{staging}/{path}"
                        store.create_dir(posixpath.dirname(name), recursive=True)
                        out = store.open_output_stream(name)
                        out.write(wav_head(frames, self.width, self.rate, 3 if self.scale is None else 1))
                        files.append((path, frames))
                    left -= len(samples)
                    out.write(wav_codes(samples, self.width, self.scale))
        finally:
            if out:
                out.close()
        if left:
            raise ValueError(f"{current}: {left} frames are missing")
        return Written(staging, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, top, _ = open_store(self.folder)
        made = {posixpath.dirname(f"{top}/{path}") for m in messages if m for path, _ in m.files}
        for folder in sorted(made):
            store.create_dir(folder, recursive=True)

        def place(move: tuple[str, str]) -> None:
            store.move(f"{top}/{move[0]}/{move[1]}", f"{top}/{move[1]}")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(place, [(m.staging, path) for m in messages if m for path, _ in m.files]))
        self._clear(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        store, top, _ = open_store(self.folder)
        self._clear(store, top)

    def _clear(self, store, top: str) -> None:
        if store.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.job}")


class WavSink(DataSource):
    """``df.write.format("wav_files").option("subtype", "PCM_16").mode("append").save(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "wav_files"

    def schema(self) -> str:
        return "path STRING, frames BIGINT, samples ARRAY<FLOAT>"

    def writer(self, schema, overwrite: bool) -> WavWriter:
        if overwrite:
            raise ValueError("files are added to a folder; remove the old ones first")
        return WavWriter(dict(self.options), overwrite)


def write_wav(blocks: DataFrame, folder: str, subtype: str = "PCM_16", rate: int = SAMPLE_RATE) -> DataFrame:
    """Writes one mono file per ``path`` under a folder of any store: rows (path, frames).

    ``blocks`` has (path, block, samples); null paths are left out. Codes hold values in [-1, 1) and clip what is beyond,
    the subtype FLOAT holds every value. The blocks of a file stream
    through one task in order, one batch in memory at a time. The write is done when the function returns. Files appear
    under their names when all of them are complete; files of those names are replaced.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(WavSink)
    rows = blocks.where("path is not null").select("path", "block", F.col("samples").cast("array<float>").alias("samples"))
    totals = rows.groupBy(F.col("path").alias("_path")).agg(F.sum(F.size("samples")).cast("bigint").alias("frames"))
    totals = settled(totals)
    sized = rows.join(totals, F.col("path") == F.col("_path")).select("path", "block", "frames", "samples")
    ordered = spread_groups(sized, "path").sortWithinPartitions("path", "block").select("path", "frames", "samples")
    ordered.write.format("wav_files").options(subtype=subtype, rate=str(rate)).mode("append").save(folder)
    return totals.select(F.col("_path").alias("path"), "frames")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under a folder as (path, modificationTime, length, content). Unselected content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def wav_bytes(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    """A mono 16-bit file in memory; for small fixtures."""
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as handle:
        handle.setnchannels(1)
        handle.setsampwidth(2)
        handle.setframerate(rate)
        handle.writeframes(np.clip(np.rint(samples * 32768), -32768, 32767).astype("<i2").tobytes())
    return buffer.getvalue()
