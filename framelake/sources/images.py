"""Image folders as tables: extension filter, provenance columns, pluggable decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.names import extension, relative_path
from framelake.functions.imaging import bilinear

DEFAULT_EXTENSIONS = "jpg,jpeg,png,bmp,tiff,pgm"
IMAGE_SCHEMA = (
    "absolute_path string, relative_path string, extension string, size_bytes bigint, "
    "width int, height int, format string, pixels binary"
)

Decoder = Callable[[bytes], np.ndarray]


def decode_pgm(data: bytes) -> np.ndarray:
    """Gray image of a portable graymap, plain (P2) or binary (P5), up to 8 bits."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    kind, width, height, top = fields[0], *map(int, fields[1:])
    if kind not in (b"P2", b"P5") or not 0 < top < 256:
        raise ValueError("not an 8-bit graymap")
    if kind == b"P5":
        return np.frombuffer(data, np.uint8, width * height, at + 1).reshape(height, width)
    body = b"\n".join(row.split(b"#")[0] for row in data[at:].split(b"\n"))
    return np.array(body.split()[: width * height], np.uint8).reshape(height, width)


def extensions(text: str) -> list[str]:
    parts = (item.strip(" \t").lower() for item in text.split(","))
    return sorted({p if p.startswith(".") else f".{p}" for p in parts if p})


def glob_of(suffixes: list[str]) -> str:
    """File name pattern of these extensions in any case."""

    def either(c: str) -> str:
        return f"[{c.lower()}{c.upper()}]" if c.isalpha() else c if c == "." or c.isalnum() else "?"

    return "*{" + ",".join("".join(map(either, s)) for s in suffixes) + "}" if suffixes else "*"


def list_images(spark: SparkSession, root: str, recursive: bool = False, allowed: str = DEFAULT_EXTENSIONS) -> DataFrame:
    """Files whose lower-cased extension is allowed, with provenance and raw content.

    Other files are left out by name while listing, so their content is never read.
    """
    wanted = extensions(allowed)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob_of(wanted))
        .load(root)
    )
    path = F.regexp_replace("path", "^file:/+", "/")
    return (
        files.select(
            path.alias("absolute_path"),
            relative_path(path, F.lit(root)).alias("relative_path"),
            extension(path).alias("extension"),
            F.col("length").alias("size_bytes"),
            "content",
        )
        .where(F.col("extension").isin(wanted))
    )


def scan_images(
    spark: SparkSession,
    root: str,
    recursive: bool = False,
    allowed: str = DEFAULT_EXTENSIONS,
    decoder: Decoder = decode_pgm,
    size: tuple[int, int] | None = None,
) -> DataFrame:
    """Decoded images, optionally scaled to (width, height). A bad file fails the job."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [decoder(bytes(content)) for content in batch["content"]]
            if size:
                images = [bilinear(image, *size) for image in images]
            yield batch.drop(columns="content").assign(
                width=[i.shape[1] for i in images],
                height=[i.shape[0] for i in images],
                format=["GRAY8" if i.ndim == 2 else "RGB" for i in images],
                pixels=[i.tobytes() for i in images],
            )

    return list_images(spark, root, recursive, allowed).mapInPandas(decode, IMAGE_SCHEMA)
