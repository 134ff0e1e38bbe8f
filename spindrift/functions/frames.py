"""Sizes and frame counts of videos and images as expressions: multiples of a factor under bounds of pixels and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of a side and of a frame count; bounds of an image, of a video frame and of a whole video in pixels; the largest ratio; frames.
SIDE, FRAME = 28, 2
IMAGE_PIXELS, VIDEO_PIXELS, TOTAL_PIXELS = (4 * 28 * 28, 16384 * 28 * 28), (128 * 28 * 28, 768 * 28 * 28), int(128_000 * 28 * 28 * 0.9)
RATIO, FPS, MIN_FRAMES, MAX_FRAMES = 200, 2.0, 4, 768


def nearest(x: Column, factor: int) -> Column:
    """The nearest multiple; halves go to the even one."""
    return (F.rint(x / factor) * factor).cast("long")


def above(x: Column, factor: int) -> Column:
    return (F.ceil(x / factor) * factor).cast("long")


def below(x: Column, factor: int) -> Column:
    return (F.floor(x / factor) * factor).cast("long")


def _refused(bad: Column, message: Column, good: Column, strict: bool) -> Column:
    """``good`` where nothing is bad; else an error, or null if not ``strict``."""
    return F.when(~F.coalesce(bad, F.lit(True)), good).otherwise(F.raise_error(message).cast("long") if strict else F.lit(None).cast("long"))


def smart_size(height: Column, width: Column, factor: int = SIDE, least: Column | int = IMAGE_PIXELS[0], most: Column | int = IMAGE_PIXELS[1], strict: bool = True) -> tuple[Column, Column]:
    """(height, width) as multiples of ``factor`` with ``least`` to ``most`` pixels and nearly the ratio of before.

    Sides go to the nearest multiple; an image that is too large or too small then is scaled by the root of its
    excess and rounded down or up. A ratio over 200 is an error, or null if not ``strict``.
    """
    least, most = (F.lit(x) if isinstance(x, int) else x for x in (least, most))
    h, w = height.cast("double"), width.cast("double")
    ratio = F.greatest(h, w) / F.nullif(F.least(h, w), F.lit(0.0))
    sides = [F.greatest(F.lit(factor).cast("long"), nearest(x, factor)) for x in (h, w)]
    pixels = sides[0] * sides[1]
    shrink, grow = F.sqrt(h * w / most), F.sqrt(least / F.nullif(h * w, F.lit(0.0)))
    message = F.concat(F.lit(f"the ratio of the sides must be at most {RATIO}, it is "), F.coalesce(ratio.cast("string"), F.lit("none")))
    out = [F.when(pixels > most, below(x / shrink, factor)).when(pixels < least, above(x * grow, factor)).otherwise(side) for x, side in zip((h, w), sides, strict=True)]
    return tuple(_refused(ratio > RATIO, message, x, strict) for x in out)


def frame_pixels(frames: Column, least: int = VIDEO_PIXELS[0], most: int = VIDEO_PIXELS[1], total: int = TOTAL_PIXELS) -> Column:
    """The most pixels of one frame: a share of the video's budget, but not under a twentieth over the least."""
    return F.greatest(F.least(F.lit(float(most)), F.lit(total) / frames * FRAME), F.lit(float(int(least * 1.05))))


def frame_count(total: Column, video_fps: Column, fps: Column | float | None = None, frames: Column | int | None = None, least: int = MIN_FRAMES, most: int | None = None, strict: bool = True) -> Column:
    """How many of a video's ``total`` frames are taken: by a rate within ``least`` and ``most``, or a given number; even.

    Both a rate and a number is an error. A result that is not from 2 to ``total`` is an error, or null if not ``strict``.
    """
    if fps is not None and frames is not None:
        raise ValueError("either a rate or a number of frames")
    if frames is not None:
        n = nearest(F.lit(frames) if isinstance(frames, int) else frames, FRAME)
    else:
        rate = F.lit(FPS) if fps is None else F.lit(fps) if isinstance(fps, int | float) else fps
        top = below(F.least(F.lit(MAX_FRAMES), total) if most is None else F.lit(most), FRAME)
        bottom = above(F.lit(least), FRAME)
        n = below(F.least(F.least(F.greatest(F.try_divide(total, video_fps) * rate, bottom), top), total), FRAME)
    message = F.concat(F.lit(f"the number of frames must be from {FRAME} to "), F.coalesce(total.cast("string"), F.lit("null")), F.lit(", it is "), F.coalesce(n.cast("string"), F.lit("null")))
    return _refused((n < FRAME) | (n > total), message, n, strict)


def clip_frames(start: Column, end: Column, fps: Column | float, total: Column, strict: bool = True) -> tuple[Column, Column, Column]:
    """First and last frame of a clip in seconds, and their number; without start and end the whole video.

    Times are cut to the video. A first frame that is not before the last, or a video without frames, is an error, or
    null if not ``strict``.
    """
    rate = F.lit(fps).cast("double") if isinstance(fps, int | float) else fps
    cut = lambda x: F.greatest(F.lit(0.0), F.least(x, F.try_divide(total, rate)))
    first = F.when(start.isNotNull(), F.ceil(cut(start) * rate)).otherwise(0).cast("long")
    last = F.when(end.isNotNull(), F.least(F.floor(cut(end) * rate), total - 1)).otherwise(total - 1).cast("long")
    whole = start.isNull() & end.isNull()
    message = F.concat(F.lit("a clip must begin before it ends: frames "), F.coalesce(first.cast("string"), F.lit("null")), F.lit(" and "), F.coalesce(last.cast("string"), F.lit("null")))
    bad = (rate <= 0) | (total <= 0) | (~whole & (first >= last))
    return tuple(_refused(bad, message, x, strict) for x in (first, last, last - first + 1))
