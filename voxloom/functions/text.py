"""Column functions for names, labels, times and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names cannot have, and names that are reserved.
INVALID = r'[\\/:*?"<>|\x00-\x1F]'
RESERVED = (
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)
# Filter presets by name.
FILTERS = {
    "off": "",
    "voice": "highpass=f=80,lowpass=f=7500,speechnorm=e=3",
    "denoise": "highpass=f=80,afftdn=nf=-25,lowpass=f=7500,speechnorm=e=3",
    "declip": "adeclip,highpass=f=80,speechnorm=e=3",
}
# Upload extensions.
EXTENSIONS = ("mp3", "wav", "m4a", "flac", "ogg", "opus", "aac", "wma", "mp4", "mkv", "mov", "webm", "avi")


def strip(text: Column) -> Column:
    """text without white space at its ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def safe_name(name: Column, fallback: Column) -> Column:
    """A file name: invalid characters become _, ends lose spaces and dots, inner space is single, 100 characters."""
    cleaned = strip(F.regexp_replace(strip(F.coalesce(name, F.lit(""))), INVALID, "_"))
    cleaned = F.regexp_replace(cleaned, r"^\.+|\.+$", "")
    cleaned = strip(F.substring(F.regexp_replace(cleaned, r"(?U)\s+", " "), 1, 100))
    return F.when((cleaned == "") | F.upper(cleaned).isin(*RESERVED), fallback).otherwise(cleaned)


def anonymous_label(index: Column) -> Column:
    """Speaker A to Z, then AA to ZZ, then AAA and so on, for indexes from 0 to 2^53."""
    start = F.struct(index.cast("long").alias("rest"), F.lit("").alias("letters"))

    def step(acc: Column, _: Column) -> Column:
        letter = F.char(F.lit(65) + acc["rest"] % 26)
        longer = F.struct((F.floor(acc["rest"] / F.lit(26)).cast("long") - 1).alias("rest"), F.concat(letter, acc["letters"]).alias("letters"))
        return F.when(acc["rest"] >= 0, longer).otherwise(acc)

    most = 12  # letters of 2^53
    return F.concat(F.lit("Speaker "), F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: acc["letters"]))


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds; hours go beyond 99."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def default_name(now: Column) -> Column:
    """The name of a result that was given none: the day."""
    return F.date_format(now, "yyyy-MM-dd")


def filter_chain(name: Column) -> Column:
    """The preset of a name in any case; other names are chains themselves, and null is off."""
    key = F.trim(F.coalesce(F.when(name == "", None).otherwise(name), F.lit("off")))
    presets = F.create_map(*[F.lit(x) for pair in FILTERS.items() for x in pair])
    return F.coalesce(F.element_at(presets, F.lower(key)), key)


def allowed_upload(path: Column, length: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*EXTENSIONS) & (length > 0)


def error_kind(message: Column) -> Column:
    """What an error text is about: memory, cuda, symlink, access or other, the first that fits."""
    low = F.lower(message)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))
    return (
        F.when(has("out of memory"), "memory")
        .when(has("cudnn", "cublas"), "cuda")
        .when(has("1314", "symlink", "symbolic link"), "symlink")
        .when(has("401", "403", "gated"), "access")
        .otherwise("other")
    )


def initial_prompt(names: Column, glossary: Column) -> Column:
    """Names joined by commas and closed by a full stop, then the glossary; nothing of what is missing."""
    people = F.when(F.size(names) > 0, F.concat(F.array_join(names, ", "), F.lit(".")))
    words = strip(F.coalesce(glossary, F.lit("")))
    return F.concat_ws(" ", people, F.when(words != "", words))
