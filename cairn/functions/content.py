"""Content identifiers, the LZ4 blob files that they name, and deterministic directory archives."""

from __future__ import annotations

import base64
import io
import os
import tarfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.blake3 import Hasher, digests
from cairn.functions.expr import CID_PREFIX
from cairn.shipping import ship

READ = 4 << 20


def cid_bytes(digest: bytes, profile: str = "blake3") -> bytes:
    return bytes.fromhex(CID_PREFIX[profile]) + digest


def cid_text(cid: bytes) -> str:
    return "b" + base64.b32encode(cid).decode().lower().rstrip("=")


def cid_parse(text: str) -> bytes:
    """36 bytes from a CID's text; ValueError for anything else."""
    if len(text) != 59 or text[0] != "b":
        raise ValueError(f"invalid CID: {text}")
    try:
        cid = base64.b32decode(text[1:].upper() + "=" * (-len(text[1:]) % 8))
    except ValueError:
        raise ValueError(f"invalid CID: {text}") from None
    if cid[:4].hex() not in CID_PREFIX.values():
        raise ValueError(f"invalid CID: {text}")
    return cid


def compute_cid(data: bytes) -> bytes:
    return cid_bytes(digests([data])[0])


def blake3_cids(rows: DataFrame, content: str, into: str = "cid") -> DataFrame:
    """``rows`` with the CID text of the column ``content`` (text or bytes), hashed in Arrow batches."""
    ship(rows.sparkSession)
    schema = rows.withColumn(into, F.lit("")).schema
    at = rows.columns.index(content)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out, held, size = [], [], 0
            for x in batch.column(at):
                v = x.as_py()
                held.append(v.encode() if isinstance(v, str) else v or b"")
                size += len(held[-1])
                if size >= READ:
                    out += digests(held)
                    held, size = [], 0
            out += digests(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([cid_text(cid_bytes(d)) for d in out], pa.string())], [*batch.schema.names, into])

    return rows.mapInArrow(run, schema)


def lz4(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.compress(data, codec="lz4", asbytes=True)


def unlz4(frame: bytes) -> bytes:
    import pyarrow as pa

    return pa.input_stream(pa.BufferReader(frame), compression="lz4").read()


class BlobStore:
    """One LZ4 frame for each content, named by its CID. Writes are atomic and writing again changes nothing."""

    def __init__(self, root: str):
        self.root = root

    def path(self, cid: bytes) -> str:
        return os.path.join(self.root, cid_text(cid) + ".lz4")

    def exists(self, cid: bytes) -> bool:
        return os.path.exists(self.path(cid))

    def compressed_size(self, cid: bytes) -> int | None:
        try:
            return os.path.getsize(self.path(cid))
        except FileNotFoundError:
            return None

    def store(self, cid: bytes, data: bytes) -> int:
        """The stored size. A task that runs twice, or beside its copy, leaves one file."""
        known = self.compressed_size(cid)
        return known if known is not None else self._put(cid, lambda f: f.write(lz4(data)))

    def _put(self, cid: bytes, write: Callable) -> int:
        os.makedirs(self.root, exist_ok=True)
        own = f"{self.path(cid)}.{os.getpid()}.{uuid.uuid4().hex}.tmp"
        try:
            with open(own, "wb") as f:
                write(f)
            os.replace(own, self.path(cid))
        finally:
            if os.path.exists(own):
                os.remove(own)
        return os.path.getsize(self.path(cid))

    def store_file(self, name: str) -> tuple[bytes, int, int]:
        """(cid, size, stored size) of a file, read in parts: once to hash, and once more only if its content is new."""
        import pyarrow as pa

        hasher, size = Hasher(), 0
        with open(name, "rb") as f:
            while part := f.read(READ):
                hasher.update(part)
                size += len(part)
        cid = cid_bytes(hasher.digest())
        known = self.compressed_size(cid)
        if known is None:

            def copy(out):
                with open(name, "rb") as f, pa.CompressedOutputStream(out, "lz4") as packed:
                    while part := f.read(READ):
                        packed.write(part)

            known = self._put(cid, copy)
        return cid, size, known

    def read(self, cid: bytes) -> bytes:
        try:
            with open(self.path(cid), "rb") as f:
                return unlz4(f.read())
        except FileNotFoundError:
            raise FileNotFoundError(f"blob not found: {cid_text(cid)}") from None

    def cids(self) -> Iterator[str]:
        if os.path.isdir(self.root):
            yield from (n[:-4] for n in os.listdir(self.root) if n.endswith(".lz4"))


class Cancelled(RuntimeError):
    def __init__(self):
        super().__init__("scan cancelled")


def directory_archive(folder: str, name: str | None = None, cancelled: Callable[[], bool] = lambda: False) -> bytes:
    """A GNU tar of a directory whose bytes depend on names and contents only: members sorted, owners and times zero, modes fixed, links left out.

    Any file that can't be read fails the whole archive.
    """
    name = name or os.path.basename(os.path.normpath(folder)) or "archive"
    found: list[tuple[str, str, bool]] = [(name, folder, True)]

    def look(at: str, shown: str) -> None:
        for e in os.scandir(at):
            if cancelled():
                raise Cancelled
            if e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                found.append((f"{shown}/{e.name}", e.path, True))
                look(e.path, f"{shown}/{e.name}")
            elif e.is_file(follow_symlinks=False):
                found.append((f"{shown}/{e.name}", e.path, False))

    look(folder, name)
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for shown, at, is_dir in sorted(found):
            if cancelled():
                raise Cancelled
            info = tarfile.TarInfo(shown)
            info.type, info.mode = (tarfile.DIRTYPE, 0o755) if is_dir else (tarfile.REGTYPE, 0o644)
            if is_dir:
                tar.addfile(info)
            else:
                with open(at, "rb") as f:
                    data = f.read()
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return out.getvalue()
