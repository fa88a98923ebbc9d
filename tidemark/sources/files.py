"""Small files on any Hadoop file system, through the session's own client."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name) if name else self._root

    def create(self, name: str, text: str) -> bool:
        """Write a new file; false if there is one by that name already.

        The content goes to a file of its own first and is moved into place without overwriting,
        so a reader never sees half of it and two writers never both win.
        """
        part = self._path(f".{name.replace('/', '_')}.{self._jvm.java.util.UUID.randomUUID()}")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        try:
            if str(self._fs.getScheme()) == "file":
                java = self._jvm.java.nio.file
                made = self._link(java, part, target)
            else:
                made = bool(self._fs.rename(part, target))
        finally:
            self._fs.delete(part, False)
        return made

    def _link(self, java, part, target) -> bool:
        # A rename on a local disk replaces its target; a hard link does not.
        try:
            java.Files.createLink(self._java_path(target), self._java_path(part))
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _java_path(self, path):
        return self._jvm.java.io.File(path.toUri().getPath()).toPath()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._path(name)))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(str(s.getPath().getName()) for s in self._fs.listStatus(path))

    def age(self, name: str) -> float:
        """Seconds since the last change of a file or folder, by this machine's clock."""
        changed = self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000
        return time.time() - changed

    def size(self, name: str) -> int:
        return int(self._fs.getContentSummary(self._path(name)).getLength())

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
