"""Files that exist once: what several drivers agree by, in the folder that they share."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of a Hadoop file system, or of the local one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        """Names in a folder, sorted; none where it is missing."""
        at = self._at(name)
        found = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(n for n in found if n[0] not in "._")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def _write(self, name: str, text: str) -> None:
        out = self.fs.create(self._at(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def mark(self, name: str) -> None:
        """An empty file; making it again changes nothing."""
        self._write(name, "")

    def move_new(self, name: str, to: str) -> bool:
        """Gives a folder its name unless there is one of that name; of several that try at once one succeeds."""
        if self.exists(to) or not self.fs.rename(self._at(name), self._at(to)):
            return False
        # a rename onto a folder that came meanwhile puts this one inside it
        inside = f"{to}/{name.rsplit('/', 1)[1]}"
        if self.exists(inside):
            self.delete(inside)
            return False
        return True

    def put_new(self, name: str, text: str) -> bool:
        """Makes a file with its whole text, unless there is one of that name: of several writers one succeeds.

        The text is written aside, then gets its name by what the file system does in one step
        and never over another file: a link on a local one, a rename on others.
        """
        aside = f"staging/{uuid.uuid4().hex}"
        self._write(aside, text)
        target = self._at(name)
        self.fs.mkdirs(target.getParent())
        try:
            if not self.local:
                return self.fs.rename(self._at(aside), target)
            plain = lambda p: self.jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0))
            self.jvm.java.nio.file.Files.createLink(plain(target), plain(self._at(aside)))
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.delete(aside)
