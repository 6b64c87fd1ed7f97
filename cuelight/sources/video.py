"""From video files to frames and back: cut, re-encode, probe, decode, write.

What touches a file is a tool with four methods, so that workers need ffmpeg only where videos are compressed:
``RawTools`` reads and writes the library's own container (a line of JSON, then raw frames), ``FfmpegTools`` runs ffmpeg
and ffprobe. Each step is a narrow pass over small rows (paths and numbers) that are spread over the cluster first;
files go to a folder that all workers see, under names that depend on their input alone, and a file that is there
already is not made again, so a step that is repeated after a lost executor gives the same files.
"""

from __future__ import annotations

import json
import os
import struct
import subprocess
import uuid
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.functions.images import as_image, resized, with_boxes
from cuelight.operators.ingest import chunk_offsets
from cuelight.plans.settings import Ingest
from cuelight.schema import FRAME
from cuelight.sources.frames import encode_command, run_ffmpeg, segment_command

#: Frames that a worker sends on at a time.
BATCH = 16
_META = "width int, height int, nb_frames int, duration double, fps int, bit_rate int"


class Tools(Protocol):
    def chunk(self, uri: str, seconds: int, folder: str) -> list[tuple[int, str]]: ...
    def encode(self, uri: str, width: int, height: int, fps: int, folder: str) -> str: ...
    def probe(self, uri: str) -> dict[str, float]: ...
    def decode(self, uri: str, first: int, last: int) -> Iterator[np.ndarray]: ...


def _name(uri: str) -> str:
    """A file's name without folder and extension, told from equal names in other folders."""
    path = local_path(uri)
    return f"{os.path.splitext(os.path.basename(path))[0]}-{zlib.crc32(path.encode()):08x}"


def local_path(uri: str) -> str:
    return uri.removeprefix("file://").removeprefix("file:")


def write_clip(path: str, images: Iterator[np.ndarray] | list[np.ndarray], width: int, height: int, fps: int) -> int:
    """Frames as one raw file, put in place when it is whole; returns their number."""
    part, n = f"{path}.{uuid.uuid4().hex}", 0
    with open(part, "wb") as f:
        f.write((json.dumps({"width": width, "height": height, "fps": fps}) + "\n").encode())
        for image in images:
            f.write(np.ascontiguousarray(image, np.uint8).tobytes())
            n += 1
    os.replace(part, path)
    return n


class RawTools:
    """Raw frames behind a line of JSON."""

    extension = ".rgb"

    def probe(self, uri: str) -> dict[str, float]:
        path = local_path(uri)
        with open(path, "rb") as f:
            line = f.readline()
        head = json.loads(line)
        n = (os.path.getsize(path) - len(line)) // (head["width"] * head["height"] * 3)
        seconds = n / head["fps"]
        return {"width": head["width"], "height": head["height"], "nb_frames": n, "duration": seconds, "fps": head["fps"], "bit_rate": int(8 * os.path.getsize(path) / seconds) if n else 0}

    def decode(self, uri: str, first: int, last: int) -> Iterator[np.ndarray]:
        about = self.probe(uri)
        size = about["width"] * about["height"] * 3
        with open(local_path(uri), "rb") as f:
            f.readline()
            f.seek(first * size, os.SEEK_CUR)
            for _ in range(first, min(last, about["nb_frames"] - 1) + 1):
                yield as_image(f.read(size), about["width"], about["height"])

    def chunk(self, uri: str, seconds: int, folder: str) -> list[tuple[int, str]]:
        about, out = self.probe(uri), []
        step = max(1, seconds * about["fps"])
        for i, lo in enumerate(range(0, about["nb_frames"], step)):
            path = f"{folder}/{_name(uri)}_{i}{self.extension}"
            if not os.path.exists(path):
                write_clip(path, self.decode(uri, lo, lo + step - 1), about["width"], about["height"], about["fps"])
            out.append((i, path))
        return out

    def encode(self, uri: str, width: int, height: int, fps: int, folder: str) -> str:
        path = f"{folder}/{_name(uri)}_{width}x{height}_{fps}{self.extension}"
        if not os.path.exists(path):
            about = self.probe(uri)
            n = -(-about["nb_frames"] * fps // about["fps"])
            picked = {int(i * about["fps"] / fps) for i in range(n)}
            kept = (resized(x, height, width) for i, x in enumerate(self.decode(uri, 0, about["nb_frames"] - 1)) if i in picked)
            write_clip(path, kept, width, height, fps)
        return path


class FfmpegTools:
    """Compressed videos by the programs ffmpeg and ffprobe of the workers."""

    extension = ".mp4"

    def chunk(self, uri: str, seconds: int, folder: str) -> list[tuple[int, str]]:
        own = f"{folder}/{_name(uri)}"
        if not os.path.exists(own):
            part = f"{own}.{uuid.uuid4().hex}"
            os.makedirs(part)
            run_ffmpeg(segment_command(local_path(uri), seconds, f"{part}/%d{self.extension}"))
            try:
                os.rename(part, own)
            except OSError:  # another attempt was first
                pass
        return sorted((int(os.path.splitext(n)[0]), f"{own}/{n}") for n in os.listdir(own))

    def encode(self, uri: str, width: int, height: int, fps: int, folder: str) -> str:
        path = f"{folder}/{_name(uri)}_{width}x{height}_{fps}{self.extension}"
        if not os.path.exists(path):
            part = f"{path}.{uuid.uuid4().hex}{self.extension}"
            run_ffmpeg(encode_command(local_path(uri), width, height, fps, part))
            os.replace(part, path)
        return path

    def probe(self, uri: str) -> dict[str, float]:
        done = subprocess.run(["ffprobe", "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height,nb_frames,duration,r_frame_rate,bit_rate", "-of", "json", local_path(uri)], capture_output=True, text=True, check=True)
        return parse_probe(done.stdout)

    def decode(self, uri: str, first: int, last: int) -> Iterator[np.ndarray]:
        about = self.probe(uri)
        size = int(about["width"] * about["height"] * 3)
        command = ["ffmpeg", "-v", "error", "-i", local_path(uri), "-vf", f"select=between(n\\,{first}\\,{last})", "-vsync", "0", "-f", "rawvideo", "-pix_fmt", "bgr24", "-"]
        with subprocess.Popen(command, stdout=subprocess.PIPE) as run:
            while len(raw := run.stdout.read(size)) == size:
                yield as_image(raw, int(about["width"]), int(about["height"]))


def parse_probe(text: str) -> dict[str, float]:
    """ffprobe's JSON of the first video stream; a rate is a fraction."""
    stream = json.loads(text)["streams"][0]
    above, _, below = stream["r_frame_rate"].partition("/")
    return {"width": int(stream["width"]), "height": int(stream["height"]), "nb_frames": int(stream.get("nb_frames") or 0), "duration": float(stream.get("duration") or 0), "fps": round(int(above) / int(below or 1)), "bit_rate": int(stream.get("bit_rate") or 0)}


def chunked(videos: DataFrame, tools: Tools, seconds: int, folder: str) -> DataFrame:
    """(video, chunk, uri) of the pieces of (uri, id) videos."""

    def cut(parts):
        os.makedirs(folder, exist_ok=True)
        for p in parts:
            rows = [(u, i, path) for u in p["uri"] for i, path in tools.chunk(u, seconds, folder)]
            yield pd.DataFrame(rows, columns=["video", "chunk", "uri"])

    return videos.select("uri").repartition("uri").mapInPandas(cut, "video string, chunk int, uri string")


def encoded(chunks: DataFrame, tools: Tools, width: int, height: int, fps: int, folder: str) -> DataFrame:
    """The pieces at the wanted size and rate."""

    def change(parts):
        os.makedirs(folder, exist_ok=True)
        for p in parts:
            yield p.assign(uri=[tools.encode(u, width, height, fps, folder) for u in p["uri"]])

    return chunks.repartition("video", "chunk").mapInPandas(change, chunks.schema)


def probed(chunks: DataFrame, tools: Tools) -> DataFrame:
    """The pieces with size, frames, duration, rate and bits a second."""

    def look(parts):
        for p in parts:
            about = pd.DataFrame([tools.probe(u) for u in p["uri"]], columns=[c.split()[0] for c in _META.split(", ")], index=p.index)
            yield pd.concat([p, about], axis=1)

    return chunks.mapInPandas(look, f"video string, chunk int, uri string, {_META}")


def decoded(chunks: DataFrame, tools: Tools, start: float = 0.0, end: float = 1.0) -> DataFrame:
    """Frames of the part [start, end] of each video, numbered through its pieces; pieces outside of it are not opened."""
    counted = chunks.select("video", "chunk", F.col("uri").alias("file"), F.col("nb_frames").cast("long").alias("chunk_frames"))
    placed = chunk_offsets(counted.withColumnRenamed("video", "uri"), by_video=True)
    low, high = F.floor(F.col("total_frames") * F.lit(start)), F.floor(F.col("total_frames") * F.lit(end))
    inside = placed.filter((F.col("end_chunk") >= low) & (F.col("start_chunk") <= high) & (F.col("chunk_frames") > 0))
    wanted = inside.select("uri", "chunk", "file", "start_chunk", F.greatest("start_chunk", low).alias("first"), F.least("end_chunk", high).alias("last"))

    def read(parts):
        for p in parts:
            for r in p.itertuples(index=False):
                out = []
                for i, image in enumerate(tools.decode(r.file, int(r.first - r.start_chunk), int(r.last - r.start_chunk))):
                    out.append((r.uri, int(r.first) + i, image.shape[1], image.shape[0], image.tobytes()))
                    if len(out) == BATCH:
                        yield pd.DataFrame(out, columns=FRAME.names)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=FRAME.names)

    return wanted.repartition("uri", "chunk").mapInPandas(read, FRAME)


def ingest(videos: DataFrame, tools: Tools, folder: str, options: Ingest | None = None) -> DataFrame:
    """Frames (uri, id, width, height, framebytes) of the catalogue's videos: cut, re-encoded, probed and decoded."""
    o = options or Ingest()
    pieces = chunked(videos, tools, o.chunk_size_s, f"{folder}/chunks")
    ready = encoded(pieces, tools, o.width, o.height, o.fps, f"{folder}/encoded")
    return decoded(probed(ready, tools), tools, o.start_fraction, o.end_fraction)


def png(image: np.ndarray) -> bytes:
    """The image as an 8-bit RGB PNG file; frames hold blue, green, red."""
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + line.tobytes() for line in np.ascontiguousarray(image[..., ::-1]))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def write_frames(frames: DataFrame, folder: str) -> DataFrame:
    """(frameuri, frameid) of the frames, each written as a PNG file named by its number in a folder of its video."""

    def write(parts):
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                own = f"{folder}/{_name(r.uri)}"
                os.makedirs(own, exist_ok=True)
                path = f"{own}/{r.id:05d}.png"
                with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(png(as_image(r.framebytes, r.width, r.height)))
                os.replace(f.name, path)
                out.append((path, r.id))
            yield pd.DataFrame(out, columns=["frameuri", "frameid"])

    return frames.mapInPandas(write, "frameuri string, frameid long")


def write_videos(frames: DataFrame, boxes: DataFrame, folder: str, fps: int = 1) -> DataFrame:
    """(uri, path, frames) of one raw clip for each video: its frames in order, with the outlines of their boxes.

    ``boxes`` are detections (uri, id, xmin, ymin, xmax, ymax); frames without any are written as they are. A video is
    read frame by frame, in the order of its numbers.
    """
    corners = ("xmin", "ymin", "xmax", "ymax")
    drawn = boxes.select("uri", "id", *[F.col(c).cast("double").alias(c) for c in corners]).dropna()
    grouped = drawn.groupBy("uri", "id").agg(F.sort_array(F.collect_list(F.array(*corners))).alias("boxes"))
    rows = frames.join(grouped, ["uri", "id"], "left").repartition("uri").sortWithinPartitions("uri", "id")

    def write(parts):
        os.makedirs(folder, exist_ok=True)
        stream = (r for p in parts for r in p.itertuples(index=False))
        row = next(stream, None)
        while row is not None:
            uri, width, height, path = row.uri, row.width, row.height, f"{folder}/{_name(row.uri)}.rgb"

            def own(uri=uri):
                nonlocal row
                while row is not None and row.uri == uri:
                    image = as_image(row.framebytes, row.width, row.height)
                    yield image if row.boxes is None else with_boxes(image, np.array([list(b) for b in row.boxes]))
                    row = next(stream, None)

            n = write_clip(path, own(), width, height, fps)
            yield pd.DataFrame([(uri, path, n)], columns=["uri", "path", "frames"])

    return rows.mapInPandas(write, "uri string, path string, frames long")
