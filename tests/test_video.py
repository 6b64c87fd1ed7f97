"""Ingest from files to frames and back, on raw clips; the ffmpeg tools by their commands' output."""

import json
import zlib

import numpy as np
import pytest

from cuelight.functions import images
from cuelight.plans.settings import Ingest
from cuelight.sources import frames as fr
from cuelight.sources import video


def _image(video_no, n):
    return np.full((12, 18, 3), (video_no * 50 + n * 7) % 256, np.uint8)


@pytest.fixture
def clips(tmp_path):
    (tmp_path / "in").mkdir()
    for v, n in ((0, 23), (1, 4), (2, 0)):
        video.write_clip(str(tmp_path / "in" / f"v{v}.rgb"), [_image(v, i) for i in range(n)], 18, 12, 2)
    return tmp_path


def test_ingest(spark, clips):
    catalog = fr.video_catalog(spark, str(clips / "in"), "*.rgb")
    o = Ingest(width=9, height=6, fps=1, chunk_size_s=3)
    rows = video.ingest(catalog, video.RawTools(), str(clips / "out"), o).collect()
    got = {(r.uri[-6:-4], r.id): r for r in rows}
    # Pieces of 6 frames at 2 a second give every second one; 23 frames end with a piece of 5, 4 with one of 4.
    assert sorted(got) == [("v0", i) for i in range(12)] + [("v1", i) for i in range(2)]
    for (v, i), r in got.items():
        assert (r.width, r.height) == (9, 6)
        assert (images.as_image(r.framebytes, 9, 6) == _image(int(v[1]), 2 * i)[0, 0, 0]).all()
    again = video.ingest(catalog, video.RawTools(), str(clips / "out"), Ingest(9, 6, 1, 3, 0.5, 0.75))
    assert sorted((r.uri[-6:-4], r.id) for r in again.collect()) == [("v0", 5), ("v0", 6), ("v0", 7), ("v0", 8), ("v1", 0)]
    one = fr.single_video(spark, str(clips / "in" / "v1.rgb"))
    assert video.ingest(one, video.RawTools(), str(clips / "out"), o).count() == 2


def test_catalogue_by_folder(spark, tmp_path):
    for name in ("b/2.rgb", "b/10.rgb", "a/z.rgb"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = fr.video_catalog(spark, str(tmp_path), "*.rgb").orderBy("id").collect()
    assert [(r.id, "/".join(r.uri.split("/")[-2:])) for r in got] == [(0, "a/z.rgb"), (1, "b/10.rgb"), (2, "b/2.rgb")]


def test_write_frames_and_videos(spark, tmp_path):
    frames = fr.synthetic_frames(spark, 10, videos=2)
    boxes = spark.createDataFrame([("video0", 2, 1.0, 1.0, 5.0, 5.0), ("video0", 2, 8.0, 8.0, 9.0, 9.0), ("video1", 3, None, 1.0, 2.0, 2.0)], "uri string, id long, xmin double, ymin double, xmax double, ymax double")
    out = {r.uri: r for r in video.write_videos(frames, boxes, str(tmp_path / "v")).collect()}
    assert {u: r.frames for u, r in out.items()} == {"video0": 5, "video1": 5}
    own = {(r.uri, r.id): images.as_image(r.framebytes, r.width, r.height) for r in frames.collect()}
    for u, ids in (("video0", range(0, 10, 2)), ("video1", range(1, 10, 2))):
        for i, image in zip(ids, video.RawTools().decode(out[u].path, 0, 99), strict=True):
            want = images.with_boxes(own[u, i], np.array([[1.0, 1, 5, 5], [8, 8, 9, 9]])) if (u, i) == ("video0", 2) else own[u, i]
            assert (image == want).all()
    written = video.write_frames(frames, str(tmp_path / "p")).collect()
    assert len(written) == 10
    for r in written[:2]:
        raw = open(r.frameuri, "rb").read()
        assert raw[:8] == b"\x89PNG\r\n\x1a\n"
        at = raw.index(b"IDAT")
        pixels = zlib.decompress(raw[at + 4 : at + 4 + int.from_bytes(raw[at - 4 : at], "big")])
        assert len(pixels) == 24 * (36 * 3 + 1)


def test_probe_and_commands():
    text = json.dumps({"streams": [{"width": 640, "height": 360, "nb_frames": "50", "duration": "2.0", "r_frame_rate": "30000/1001", "bit_rate": "800"}]})
    assert video.parse_probe(text) == {"width": 640, "height": 360, "nb_frames": 50, "duration": 2.0, "fps": 30, "bit_rate": 800}
    assert fr.encode_command("a", 36, 24, 1, "b.mp4")[4:6] == ["-vf", "scale=36:24"]
    with pytest.raises(RuntimeError):
        fr.run_ffmpeg(["no-such-program"])
