"""A commit log that makes the tables of a micro-batch visible together.

``<out>/_commits/<id>`` is written once a batch, after all its tables, by renaming a
complete file to a name that must not exist yet.  A reader (``read``) takes the
folders of committed batches only: the tables of a batch that was stopped half
way are not seen, and its replay writes them anew; a batch that is committed is
not written again.  The log belongs to one stream: its checkpoint location is
kept in ``_commits/owner``, as another stream's batch numbers begin at 0 again.

Names are listed on the driver: one a batch.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.out).getFileSystem(conf)
        qualified = self._fs.makeQualified(self._path(self.out))
        self._fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._no_overwrite[0] = rename.NONE

    def _file(self, name: str):
        return self._fs.makeQualified(self._path(f"{self.out}/_commits/{name}"))

    def _publish(self, name: str, text: str) -> bool:
        """Whether the file is new: it appears whole or not at all."""
        part = self._file(f".{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(part, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        try:
            self._fc.rename(part, self._file(name), self._no_overwrite)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._fs.delete(part, False)
            return False

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._file(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def own(self, owner: str) -> None:
        """Take the log for a stream; an error if it is another's."""
        if not self._publish("owner", owner) and (held := self._text("owner")) != owner:
            raise ValueError(f"{self.out} belongs to the stream with checkpoint {held}")

    def committed(self, batch_id: int) -> bool:
        return self._fs.exists(self._file(str(batch_id)))

    def commit(self, batch_id: int, **tables) -> bool:
        """Publish a batch; False if it was published before."""
        return self._publish(str(batch_id), json.dumps(tables))

    def batches(self) -> list[int]:
        folder = self._path(f"{self.out}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def entry(self, batch_id: int) -> dict:
        return json.loads(self._text(str(batch_id)))

    def read(self, table: str, schema=None) -> DataFrame:
        """The rows of ``<out>/<table>/batch_id=<id>`` of all committed batches, with their ``batch_id``."""
        paths = [f"{self.out}/{table}/batch_id={b}" for b in self.batches()]
        if not paths:
            if schema is None:
                raise ValueError(f"no batch of {self.out} is committed")
            return self.spark.createDataFrame([], schema)
        r = self.spark.read.option("basePath", f"{self.out}/{table}")
        return (r.schema(schema) if schema is not None else r).parquet(*paths)
