"""Steps that can be taken up again: each is written whole or not at all, and knows what it was made from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"


class _Files:
    """The file system of a folder, whatever store it is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self.path(old), self.path(new))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def listing(self, name: str) -> list[tuple[str, int, int]]:
        """(path below ``name``, size, time of change) of all files that tables read."""
        top, out = self.path(name), []
        if not self.fs.exists(top):
            return out
        base = self.fs.getFileStatus(top).getPath().toString()
        files = self.fs.listFiles(top, True)
        while files.hasNext():
            f = files.next()
            below = f.getPath().toString()[len(base):]
            if not any(part.startswith(("_", ".")) for part in below.split("/")):
                out.append((below, f.getLen(), f.getModificationTime()))
        return sorted(out)


class Steps:
    """Named steps in one folder, each a Parquet table with a manifest of its inputs.

    ``step(name, make, inputs, params)`` gives the stored table if the manifest names the same inputs, parameters and earlier
    steps; else it makes the table anew. A table is written beside its place and moved there when it is whole, its manifest
    inside, so what a killed run leaves half done counts as absent. Inputs are folders or files, told by names, sizes and
    times of change, other steps by their own fingerprints: a changed input makes all that follows from it anew. Two runs
    at once both write whole tables; the first to move its own stays.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), _Files(spark, folder)
        self.made: list[str] = []

    def fingerprint(self, inputs: list[str], params: dict, after: list[str]) -> str:
        content = {"inputs": {i: _Files(self.spark, i).listing(i) for i in sorted(inputs)}, "params": params, "after": {s: self.state(s) for s in sorted(after)}}
        return hashlib.sha256(json.dumps(content, sort_keys=True, default=str).encode()).hexdigest()

    def state(self, name: str) -> str | None:
        """The fingerprint of a finished step; None if it is absent."""
        manifest = f"{self.folder}/{name}/{MANIFEST}"
        return json.loads(self.files.read(manifest))["fingerprint"] if self.files.exists(manifest) else None

    def step(self, name: str, make: Callable[[], DataFrame], inputs: list[str] = (), params: dict | None = None, after: list[str] = ()) -> DataFrame:
        wanted, place = self.fingerprint(list(inputs), params or {}, list(after)), f"{self.folder}/{name}"
        if self.state(name) != wanted:
            beside = f"{self.folder}/_temporary-{name}-{uuid.uuid4().hex}"
            made = make()
            made.write.parquet(beside)
            self.files.write(f"{beside}/{MANIFEST}", json.dumps({"fingerprint": wanted, "schema": made.schema.json(), "inputs": sorted(inputs), "after": sorted(after)}))
            # another run may have finished the same step meanwhile
            if self.state(name) == wanted:
                self.files.delete(beside)
            else:
                self.files.delete(place)
                if not self.files.rename(beside, place):
                    raise OSError(f"{beside} could not be moved to {place}")
            self.made.append(name)
        return self.spark.read.parquet(place)

    def optional(self, path: str, read: Callable[[str], DataFrame]) -> DataFrame | None:
        """An input that may be absent."""
        return read(path) if _Files(self.spark, path).exists(path) else None

    def clear_unfinished(self) -> None:
        """Delete what killed runs have left; not while another run uses the folder."""
        top = self.files.path(self.folder)
        if self.files.fs.exists(top):
            for status in self.files.fs.listStatus(top):
                if status.getPath().getName().startswith("_temporary-"):
                    self.files.fs.delete(status.getPath(), True)
