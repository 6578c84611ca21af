"""Files through Hadoop's own interface, so that every store that Spark reaches is reached alike."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Files of a folder up to this size are digested by the executors, which hold one whole; larger ones by the driver in pieces.
DIGEST_BYTES = 512 << 20


class Store:
    """Small driver-side file operations; data files are left to Spark."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def files(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of the data files below a folder, or of a file itself."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return []
        out, todo = [], [fs.getFileStatus(where)]
        while todo:
            s = todo.pop()
            if s.isDirectory():
                todo += [x for x in fs.listStatus(s.getPath()) if not x.getPath().getName().startswith(("_", ".")) or "=" in x.getPath().getName()]
            else:
                out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def usage(self, path: str) -> tuple[int, int]:
        """(data files, bytes) below a folder."""
        found = self.files(path)
        return len(found), sum(n for _, n in found)

    def parquet_footer(self, path: str) -> tuple[int, set[str]]:
        """A Parquet file's number of row groups, and its columns' codecs."""
        parquet = self.jvm.org.apache.parquet.hadoop
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(self._at(path)[1], self.conf))
        try:
            groups = reader.getRowGroups()
            return groups.size(), {str(c.getCodec()) for g in groups for c in g.getColumns()}
        finally:
            reader.close()

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str | bytes) -> bool:
        """Write a new file at once: whole or not at all; False if the name is taken."""
        fs, where = self._at(path)
        data = text.encode() if isinstance(text, str) else text
        part = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:12]}.part")
        out = fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, where, none)
        except Exception as e:
            fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def _digest(self, stream) -> str:
        try:
            return self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def sha256(self, path: str) -> str:
        """The digest of a file's bytes, read in pieces; of a folder, that of its data files' names and digests in order. A folder's
        files are digested by the executors, and come to the driver as one short row each, a partition at a time."""
        fs, where = self._at(path)
        if not fs.exists(where):
            raise FileNotFoundError(path)
        if not fs.getFileStatus(where).isDirectory():
            return self._digest(fs.open(where))
        root = fs.makeQualified(where).toString().rstrip("/")
        large = {f: self._digest(fs.open(self._at(f)[1])) for f, n in self.files(path) if n > DIGEST_BYTES}
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= DIGEST_BYTES)
        whole, rest = hashlib.sha256(), sorted(large)
        for row in found.select("path", F.sha2("content", 256).alias("digest")).orderBy("path").toLocalIterator():
            while rest and rest[0] < row["path"]:
                whole.update(f"{rest[0].removeprefix(root)}\0{large[rest.pop(0)]}\0".encode())
            whole.update(f"{row['path'].removeprefix(root)}\0{row['digest']}\0".encode())
        for f in rest:
            whole.update(f"{f.removeprefix(root)}\0{large[f]}\0".encode())
        return whole.hexdigest()

    def verify_manifest(self, manifest: str, folder: str) -> dict[str, bool]:
        """File name -> whether its SHA-256 is that of the manifest, whose lines are `<hex digest>  <name>`."""
        out = {}
        for line in self.read(manifest).splitlines():
            if line.strip():
                digest, name = line.split(maxsplit=1)
                name = name.lstrip("*").strip()
                out[name] = self.exists(f"{folder}/{name}") and self.sha256(f"{folder}/{name}") == digest.lower()
        return out

    def verify_archive(self, archive: str, extracted: str) -> dict[str, bool]:
        """Whether a ZIP archive holds exactly one file, and that file has the extracted one's name, size and bytes."""
        fs, where = self._at(archive)
        entries = []  # name, bytes, digest
        stream = self.jvm.java.util.zip.ZipInputStream(fs.open(where))
        try:
            while (e := stream.getNextEntry()) is not None:
                if not e.isDirectory():
                    digest = self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
                    entries.append((e.getName(), e.getSize(), digest))  # the size is known once the entry has been read
        finally:
            stream.close()
        files = self.files(extracted)
        one = entries[0] if len(entries) == 1 else None
        there = one is not None and len(files) == 1
        return {
            "single_entry": one is not None,
            "same_name": one is not None and one[0].rsplit("/", 1)[-1] == extracted.rsplit("/", 1)[-1],
            "same_size": there and one[1] == files[0][1],
            "same_bytes": there and one[2] == self.sha256(extracted),
        }
