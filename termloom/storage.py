"""Small files and folders through Hadoop's file system API, so that paths may be local or shared."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """File operations below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._options = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(name))))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(self.at(name)), True)

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Writes aside and renames over name, so a reader sees the old or the new file, never a part."""
        aside = self._path(self.at(f".{name}.new"))
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        target = self._path(self.at(name))
        # the method takes varargs, for which py4j needs a Java array
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._options
        self._context.rename(self._context.makeQualified(aside), self._context.makeQualified(target), options)
