"""Frame bundles as files: one binary and one description per frame, written by a Spark data source.

Tasks write members and a list of them each; only a short receipt per task reaches the driver. A bundle whose job fails
leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from framelake.sources.paths import resolve

MEMBER_SCHEMA = "source string, frame_id bigint, folder string, metadata string, pixels binary"
LIST_SCHEMA = "source string, frame_id bigint, name string, size_bytes bigint, sha256 string, metadata string"
LISTS, CLAIM, MANIFEST, RECEIPTS = "members", "_claim", "manifest.json", "_receipts.json"


@dataclass
class Receipt(WriterCommitMessage):
    """What one task wrote: the name of its list, members and bytes."""

    name: str
    members: int
    size_bytes: int


def put(filesystem: fs.FileSystem, path: str, data) -> None:
    """A file appears whole or not at all; one that is there is replaced by the same content."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/_{name}.{uuid.uuid4().hex}"
    try:
        with filesystem.open_output_stream(part) as stream:
            stream.write(data)
        filesystem.move(part, path)
    except BaseException:
        if filesystem.get_file_info(part).type == fs.FileType.File:
            filesystem.delete_file(part)
        raise


def remove(root: str) -> None:
    """The whole bundle; nothing happens where there is none."""
    filesystem, inner = resolve(root)
    if filesystem.get_file_info(inner).type == fs.FileType.Directory:
        filesystem.delete_dir(inner)


class _BundleWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Receipt:
        filesystem, root = resolve(self.root)
        made: set[str] = set()
        filesystem.create_dir(f"{root}/{LISTS}")
        receipt = Receipt(f"{LISTS}/list-{uuid.uuid4().hex}.json", 0, 0)
        part = f"{root}/{LISTS}/_{receipt.name.rpartition('/')[2]}"
        with filesystem.open_output_stream(part) as listing:
            for batch in iterator:
                sources, ids, folders, described = (batch.column(c).to_pylist() for c in ("source", "frame_id", "folder", "metadata"))
                for row, (source, frame, folder, metadata) in enumerate(zip(sources, ids, folders, described, strict=True)):
                    if folder not in made:
                        filesystem.create_dir(f"{root}/{folder}/frames")
                        made.add(folder)
                    data = batch.column("pixels")[row].as_buffer()
                    name = f"{folder}/frames/{frame:06d}"
                    put(filesystem, f"{root}/{name}.bin", data)
                    put(filesystem, f"{root}/{name}.json", metadata.encode())
                    member = {
                        "source": source,
                        "frame_id": frame,
                        "name": f"{name}.bin",
                        "size_bytes": len(data),
                        "sha256": hashlib.sha256(data).hexdigest(),
                        "metadata": metadata,
                    }
                    listing.write(json.dumps(member).encode() + b"\n")
                    receipt.members += 1
                    receipt.size_bytes += len(data)
        filesystem.move(part, f"{root}/{receipt.name}")
        return receipt

    def commit(self, messages: list[Receipt | None]) -> None:
        """Names the lists that count, one per task; lists of repeated tasks are not among them."""
        filesystem, root = resolve(self.root)
        filesystem.create_dir(root)
        lists = [vars(m) for m in messages if m is not None]
        put(filesystem, f"{root}/{RECEIPTS}", json.dumps(lists).encode())

    def abort(self, messages: list[Receipt | None]) -> None:
        remove(self.root)


class FrameBundle(DataSource):
    """Option ``path``. Rows: source, frame_id, folder (of the source), metadata (JSON text), pixels."""

    @classmethod
    def name(cls):
        return "framebundle"

    def schema(self):
        return MEMBER_SCHEMA

    def writer(self, schema, overwrite):
        return _BundleWriter(self.options)
