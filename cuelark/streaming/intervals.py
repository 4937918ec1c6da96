"""Intervals from streams of frames, and rates of flags in windows of time.

Frames may come out of order; a video's are held back until the watermark has
passed them, then taken in order of pts. What arrives later than that is dropped
by Spark before it gets here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "video_id long, main_flag string, begin long, end long, n_points int"
STATE = "pts array<long>, flag array<boolean>, begin long, n_points int"


def stream_intervals(frames: DataFrame, flag: str, delay: str = "10 minutes") -> DataFrame:
    """Maximal runs of ``flag`` in a stream of (video_id, ts, <flag>), as microseconds.

    A run is given when the first frame after it that lacks the flag is behind the
    watermark, so the output only grows; a run that is open when the stream stops is
    not given. The state of a video is its open run and the frames of the delay.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pts, flags, begin, n = ([], [], -1, 0) if not state.exists else state.get
        pts, flags = list(pts), list(flags)
        if not state.hasTimedOut:
            for pdf in pdfs:
                pts += (pdf["ts"].astype("int64") // (1000 if str(pdf["ts"].dtype).endswith("[ns]") or "ns" in str(pdf["ts"].dtype) else 1)).tolist()
                flags += pdf["flag"].fillna(False).astype(bool).tolist()
        passed = state.getCurrentWatermarkMs() * 1000
        order = sorted(range(len(pts)), key=lambda i: pts[i])
        done, rest, rows = [i for i in order if pts[i] <= passed], [i for i in order if pts[i] > passed], []
        for i in done:
            if flags[i]:
                begin, n = (pts[i] if begin < 0 else begin), n + 1
            elif begin >= 0:
                rows.append((key[0], flag, begin, pts[i], n))
                begin, n = -1, 0
        pts, flags = [pts[i] for i in rest], [flags[i] for i in rest]
        state.update((pts, flags, begin, n))
        if pts:
            state.setTimeoutTimestamp(max(pts[0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["video_id", "main_flag", "begin", "end", "n_points"])

    slim = frames.select("video_id", "ts", F.col(flag).alias("flag")).withWatermark("ts", delay)
    return slim.groupBy("video_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def flag_rates(frames: DataFrame, flag: str, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(video_id, window, frames, share): how often the flag is set in tumbling or sliding windows; batch or stream."""
    seen = frames.withWatermark("ts", delay) if frames.isStreaming else frames
    spans = F.window("ts", window, slide) if slide else F.window("ts", window)
    return seen.groupBy("video_id", spans).agg(F.count("*").alias("frames"), F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int")).alias("share"))


def sessions(frames: DataFrame, flag: str, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(video_id, begin, end, frames): runs of set frames with no pause longer than ``gap``; batch or stream."""
    seen = frames.withWatermark("ts", delay) if frames.isStreaming else frames
    found = seen.where(F.col(flag)).groupBy("video_id", F.session_window("ts", gap)).agg(F.count("*").alias("frames"))
    return found.select("video_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "frames")
