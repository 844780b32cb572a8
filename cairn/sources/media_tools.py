"""Prints of audio and video files through command-line decoders, where they are installed.

The files must be on a path that every executor can open. A file that a tool
cannot read, or a tool that is not there, gives null.
"""

from __future__ import annotations

import re
import subprocess

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.media import RATE, chroma_hex, dhash_bits
from ..session import ship

SECONDS, LEAST_VALUES, TIMEOUT = 120, 8, 60
#: Places of the frames of a video print; seconds where the length is not known.
PLACES, BLIND_SECONDS, NO_FRAME = (0.1, 0.3, 0.5, 0.7, 0.9), (0.0, 1.0, 2.0, 3.0, 4.0), "0" * 16


def _output(*command: str) -> tuple[bytes, bytes]:
    """What a tool prints and what it reports; nothing if it is not there or takes too long."""
    try:
        done = subprocess.run(command, capture_output=True, timeout=TIMEOUT, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return b"", b""
    return done.stdout, done.stderr


def local_path(path: str) -> str:
    return re.sub("^file:/*", "/", path)


def sequence_print(report: str) -> str | None:
    """The raw fingerprint line of a report as hex of little-endian 32-bit words; null below 8 of them."""
    found = re.search(r"^FINGERPRINT=(.*)$", report, re.M)
    try:
        values = [int(v) for v in found[1].split(",") if v.strip()] if found else []
        return np.array(values, np.int64).astype("<u4").tobytes().hex() if len(values) >= LEAST_VALUES else None
    except (ValueError, OverflowError):
        return None


def frame_seconds(report: str) -> list[float]:
    """When to take the frames, by the length in a decoder's report."""
    found = re.search(r"Duration:\s*(\d+):(\d+):(\d+\.\d+)", report)
    length = sum(float(v) * unit for v, unit in zip(found.groups(), (3600, 60, 1), strict=True)) if found else 0
    return [length * place for place in PLACES] if length > 0 else list(BLIND_SECONDS)


def video_print(path: str, decoder: str) -> str | None:
    """80 hex digits, a difference hash for each of five frames; a missing frame is zeros, and no frame is no print."""
    hashes = []
    for at in frame_seconds(_output(decoder, "-i", path)[1].decode(errors="ignore")):
        raw = _output(decoder, "-ss", f"{at:.3f}", "-i", path, "-frames:v", "1", "-vf", "scale=9:8", "-pix_fmt", "gray", "-f", "rawvideo", "-")[0]
        hashes.append(f"{dhash_bits(np.frombuffer(raw, np.uint8).reshape(8, 9)):016x}" if len(raw) == 72 else NO_FRAME)
    return None if set(hashes) == {NO_FRAME} else "".join(hashes)


def audio_print(path: str, printer: str, decoder: str) -> str | None:
    """'cp:' and a sequence where the printer gives one, else 'lc:' and the local print of the decoded samples."""
    sequence = sequence_print(_output(printer, "-raw", "-length", str(SECONDS), path)[0].decode(errors="ignore"))
    if sequence:
        return f"cp:{sequence}"
    raw = _output(decoder, "-i", path, "-t", str(SECONDS), "-ac", "1", "-ar", str(RATE), "-f", "s16le", "-")[0]
    own = chroma_hex(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2"))
    return f"lc:{own}" if own else None


def media_prints(files: DataFrame, decoder: str = "ffmpeg", printer: str = "fpcalc") -> DataFrame:
    """path, vid, aud of routed files(path, route): hex prints of videos, tagged prints of audio."""
    ship(files.sparkSession)

    @F.pandas_udf("string")
    def video(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: video_print(local_path(p), decoder)).astype(object)

    @F.pandas_udf("string")
    def audio(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: audio_print(local_path(p), printer, decoder)).astype(object)

    empty = F.lit(None).cast("string")
    seen = files.where("route = 'video'").select("path", video("path").alias("vid"), empty.alias("aud"))
    return seen.unionByName(files.where("route = 'audio'").select("path", empty.alias("vid"), audio("path").alias("aud")))
