"""A folder on any file system that Spark can write to, with the one atomic step that commits need."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Folder:
    """Paths are relative to the root.  Local roots use the operating system, others Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        parsed = urlparse(self.root)
        self.local = parsed.scheme in ("", "file")
        self._at = parsed.path if self.local else self.root
        if not self.local:
            self._jvm = spark._jvm
            self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _p(self, name: str):
        return os.path.join(self._at, name) if self.local else self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def names(self, folder: str) -> list[str]:
        if self.local:
            return sorted(os.listdir(self._p(folder))) if os.path.isdir(self._p(folder)) else []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._p(folder))) if self._fs.exists(self._p(folder)) else []

    def read(self, name: str) -> str | None:
        if self.local:
            try:
                with open(self._p(name), encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        if not self._fs.exists(self._p(name)):
            return None
        stream = self._fs.open(self._p(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Make a file, whole, unless there is one of this name; whether it was made."""
        return self.settle(self.stage(name, text), name)

    def stage(self, name: str, text: str) -> str:
        """Write a hidden file beside `name`; what it is called."""
        folder = name.rpartition("/")[0]
        temporary = f"{folder}/.{uuid.uuid4().hex}" if folder else f".{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self._p(folder), exist_ok=True)
            with open(self._p(temporary), "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
        else:
            stream = self._fs.create(self._p(temporary), False)
            stream.write(bytearray(text.encode()))
            stream.close()
        return temporary

    def settle(self, temporary: str, name: str) -> bool:
        """Give a staged file its name, unless that is taken; the staged one is gone in either case."""
        if self.local:
            try:
                os.link(self._p(temporary), self._p(name))  # fails if the name is taken
                return True
            except (FileExistsError, FileNotFoundError):  # the latter: another process has settled it
                return False
            finally:
                self.delete(temporary)
        made = not self._fs.exists(self._p(name)) and self._fs.rename(self._p(temporary), self._p(name))
        if not made:
            self._fs.delete(self._p(temporary), False)
        return made

    def move(self, name: str, to: str) -> None:
        if self.local:
            os.makedirs(os.path.dirname(self._p(to)), exist_ok=True)
            os.replace(self._p(name), self._p(to))
        else:
            self._fs.mkdirs(self._p(to).getParent())
            self._fs.rename(self._p(name), self._p(to))

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        if self.local:
            return time.time() - os.path.getmtime(self._p(name))
        return time.time() - self._fs.getFileStatus(self._p(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        if not self.local:
            self._fs.delete(self._p(name), True)
        elif os.path.isdir(self._p(name)):
            shutil.rmtree(self._p(name), ignore_errors=True)
        elif os.path.exists(self._p(name)):
            os.unlink(self._p(name))

    def exists(self, name: str) -> bool:
        return os.path.exists(self._p(name)) if self.local else self._fs.exists(self._p(name))

    def size(self, name: str) -> int:
        if self.local:
            return os.path.getsize(self._p(name)) if os.path.exists(self._p(name)) else -1
        return self._fs.getFileStatus(self._p(name)).getLen() if self._fs.exists(self._p(name)) else -1
