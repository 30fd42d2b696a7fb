"""Signal-like array functions: gain, padding, cropping, lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.vectors import let, total


def clamp(arr: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.transform(arr, lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def apply_gain(arr: Column, gain_db: Column) -> Column:
    gain = F.pow(F.lit(10.0), gain_db / 20.0)
    return clamp(let(gain, lambda g: F.transform(arr, lambda x: x * g)))


def apply_volume(arr: Column, volume: float) -> Column:
    return F.transform(arr, lambda x: x * F.lit(volume))


def power(arr: Column) -> Column:
    return total(F.transform(arr, lambda x: x * x))


def snr_scale(signal: Column, noise: Column, snr_db: Column, decibel: bool = False) -> Column:
    """Noise factor for a wanted signal-to-noise ratio.

    The power ratio is (10**snr)/10; ``decibel`` takes 10**(snr/10) instead.
    """
    ratio = F.pow(F.lit(10.0), snr_db / 10.0) if decibel else F.pow(F.lit(10.0), snr_db) / 10.0
    return F.sqrt(power(signal) / (ratio * power(noise)))


def mix(signal: Column, noise: Column, scale: Column) -> Column:
    return clamp(let(scale, lambda k: F.zip_with(signal, noise, lambda s, n: s + n * k)))


def pad_right(arr: Column, length: int) -> Column:
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(arr))
    return F.concat(arr, F.array_repeat(F.lit(0.0), missing))


def shift_and_pad(arr: Column, shift: Column, length: int) -> Column:
    """Move right by ``shift`` (left when negative), zero fill, keep ``length``."""
    padded = pad_right(arr, length)
    right = F.concat(F.array_repeat(F.lit(0.0), F.greatest(shift, F.lit(0))), padded)
    left = F.concat(padded, F.array_repeat(F.lit(0.0), F.greatest(-shift, F.lit(0))))
    return F.when(shift > 0, F.slice(right, F.lit(1), F.lit(length))).otherwise(
        F.slice(left, F.lit(1) - F.least(shift, F.lit(0)), F.lit(length))
    )


def center_crop(arr: Column, length: int) -> Column:
    """Centre crop when longer, right zero pad when shorter."""
    start = F.floor((F.size(arr) - F.lit(length)) / 2).cast("int")
    return F.when(F.size(arr) > length, F.slice(arr, start + 1, F.lit(length))).otherwise(pad_right(arr, length))


def random_crop(arr: Column, length: int, u: Column) -> Column:
    """Crop of ``length`` whose start is drawn by the uniform number ``u``."""
    start = F.floor(u * (F.size(arr) - F.lit(length) + 1)).cast("int")
    return F.when(F.size(arr) > length, F.slice(arr, start + 1, F.lit(length))).otherwise(pad_right(arr, length))


def zero_pad(arr: Column, before: Column, after: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), before), arr, F.array_repeat(F.lit(0.0), after))


def time_slice(arr: Column, start_sec: Column, end_sec: Column, rate: int) -> Column:
    """Samples [round(start*rate), min(len, round(end*rate))); NULL when empty."""
    first = F.greatest(F.lit(0), F.rint(start_sec * rate).cast("int"))
    last = F.least(F.size(arr), F.rint(end_sec * rate).cast("int"))
    return F.when(last > first, F.slice(arr, first + 1, F.greatest(last - first, F.lit(0))))


def channel_mean(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2.0)


def samples_to_frames(samples: Column, window: int, hop: int) -> Column:
    """Frames of ``window`` samples every ``hop``, at least one."""
    return F.greatest(F.lit(1), F.floor((samples - F.lit(window)) / F.lit(hop)) + 1).cast("int")


def conv_length(length: Column, layers: list[tuple[int, int, int, int]]) -> Column:
    """Output length after convolutions given as (kernel, stride, padding, dilation)."""
    for k, s, p, d in layers:
        length = F.floor((length + F.lit(2 * p - d * (k - 1) - 1)) / F.lit(s)) + 1
    return F.greatest(F.lit(1), length).cast("int")


def window_starts(valid_len: Column, window: int, hop: int) -> Column:
    """Start offsets 0, hop, ... plus one tail start so that the end is covered."""
    tail = (valid_len - F.lit(window)).cast("int")
    grid = F.sequence(F.lit(0), F.greatest(tail, F.lit(0)), F.lit(hop))
    return F.when(valid_len <= window, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(grid, F.array(tail))))


def format_magnitude(x: Column, unit: str = "FLOPs") -> Column:
    return (
        F.when(x >= 1e9, F.format_string(f"%.3f G{unit}", x / 1e9))
        .when(x >= 1e6, F.format_string(f"%.3f M{unit}", x / 1e6))
        .when(x >= 1e3, F.format_string(f"%.3f K{unit}", x / 1e3))
        .otherwise(F.format_string(f"%.0f {unit}", x))
    )
