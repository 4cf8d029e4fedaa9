"""Small files of a warehouse's root: POSIX calls for mounted folders, Hadoop's file systems for all else.

`put_new` is the one primitive that commits rest on: it makes a file that is not there, or says that it is.
"""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark import SparkContext


class Mounted:
    @staticmethod
    def plain(path: str) -> str:
        return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")

    def read(self, path: str) -> str | None:
        try:
            with open(self.plain(path)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put_new(self, path: str, text: str) -> bool:
        path = self.plain(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        staged = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
        with open(staged, "w") as f:
            f.write(text)
        try:
            os.link(staged, path)  # fails if another writer has it, and shows whole files only
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(staged)

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(n for n in os.listdir(self.plain(folder)) if not n.startswith("."))
        except FileNotFoundError:
            return []

    def sizes(self, folder: str) -> dict[str, int]:
        return {n: os.path.getsize(os.path.join(self.plain(folder), n)) for n in self.names(folder)}

    def remove(self, path: str) -> None:
        path = self.plain(path)
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.unlink(path)


class Hadoop:
    """The same through the session's Hadoop configuration; `create` without overwriting is atomic in HDFS and in stores with conditional writes."""

    def _at(self, path: str):  # noqa: ANN202
        context = SparkContext._active_spark_context
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(context._jsc.hadoopConfiguration()), where

    def read(self, path: str) -> str | None:
        fs, where = self._at(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(SparkContext._active_spark_context._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        fs, where = self._at(path)
        try:
            stream = fs.create(where, False)
        except Exception as error:
            if "exists" in str(error):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def names(self, folder: str) -> list[str]:
        fs, where = self._at(folder)
        return sorted(n for s in fs.listStatus(where) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(where) else []

    def sizes(self, folder: str) -> dict[str, int]:
        fs, where = self._at(folder)
        return {s.getPath().getName(): s.getLen() for s in fs.listStatus(where)} if fs.exists(where) else {}

    def remove(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)


def files(path: str) -> Mounted | Hadoop:
    return Hadoop() if "://" in path and not path.startswith("file://") else Mounted()


def joined(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *(p.strip("/") for p in parts[1:])])
