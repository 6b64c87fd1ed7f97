"""Column layouts of the engine's relations.

A frame is one row (uri, id, width, height, framebytes); a prediction column is an array of structs, one for each
detection; a detection is one flat row. Scores are DOUBLE so that thresholds mean the same on every path.
"""

from __future__ import annotations

from pyspark.sql import types as T

VIDEO = T.StructType([T.StructField("uri", T.StringType(), False), T.StructField("id", T.IntegerType(), False)])
VIDEO_META = T.StructType([T.StructField(n, T.DoubleType() if n == "duration" else T.IntegerType()) for n in ("width", "height", "nb_frames", "duration", "fps", "bit_rate")])
FRAME_REF = T.StructType([T.StructField("frameuri", T.StringType()), T.StructField("frameid", T.LongType())])
FRAME = T.StructType([T.StructField("uri", T.StringType()), T.StructField("id", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("framebytes", T.BinaryType())])
BOX_FIELDS = ("xmin", "ymin", "xmax", "ymax")
DETECTION = T.StructType([*[T.StructField(n, T.DoubleType()) for n in BOX_FIELDS], T.StructField("label", T.StringType()), T.StructField("cls", T.IntegerType()), T.StructField("score", T.DoubleType())])
TRACKED = T.StructType([*DETECTION.fields, T.StructField("track", T.LongType())])
PREDICTIONS, TRACKS = T.ArrayType(DETECTION), T.ArrayType(TRACKED)
TRANSCRIPT = T.StructType([T.StructField("uri", T.StringType()), T.StructField("frame_id", T.LongType()), T.StructField("segment", T.StringType())])
FRAME_COLUMNS = ("uri", "id", "width", "height", "framebytes")
