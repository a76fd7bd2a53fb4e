"""Small files through Hadoop's file systems, so that any store that Spark reaches will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.array = spark.sparkContext._gateway.new_array

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def put_bytes(self, path: str, data: bytes) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()

    def publish(self, path: str, text: str) -> bool:
        """Makes a file that is there whole from the start; False if there is one of that name.

        It is written under another name first. A local file then gets its name as a link, others
        by a rename that doesn't overwrite: both fail where the name is taken.
        """
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        folder, name = path.rsplit("/", 1)
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.put_bytes(draft, text.encode())
        try:
            if self._is_local(fs):
                none = self.array(self.jvm.java.lang.String, 0)
                at = [self.jvm.java.nio.file.Paths.get(self._at(x)[1].toUri().getPath(), none) for x in (path, draft)]
                self.jvm.java.nio.file.Files.createLink(*at)
            else:
                rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                how = self.array(rename, 1)
                how[0] = rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(self._at(draft)[1], p, how)
            return True
        except Exception:
            if fs.exists(p):
                return False
            raise
        finally:
            self.delete(draft)

    @staticmethod
    def _is_local(fs) -> bool:
        return fs.getScheme() == "file"

    def read_bytes(self, path: str) -> bytes | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read(self, path: str) -> str | None:
        data = self.read_bytes(path)
        return None if data is None else data.decode(errors="replace")

    def names(self, path: str) -> list[str]:
        return [name for name, _ in self.listed(path)]

    def listed(self, path: str) -> list[tuple[str, int]]:
        """(name, changed at, in ms) of what a folder holds."""
        fs, p = self._at(path)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        fs.rename(p, self._at(to)[1])
