"""Files by URI through Hadoop's file systems, which reach whatever Spark reaches; and where raw and finished tables lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Storage:
    """exists, ls, read_bytes, write_bytes of small files, on the driver: manifests, schemas and logs, never tables."""

    spark: SparkSession
    raw_root: str = "data/raw"
    gold_root: str = "data/gold"
    bucket: str | None = None
    raw_prefix: str = "raw/"
    gold_prefix: str = "gold/"

    @staticmethod
    def of(spark: SparkSession, config) -> Storage:
        """From settings; an object store that they enable is made known to the session."""
        store = config.object_store or {}
        if not store.get("enabled"):
            return Storage(spark, config.raw_root, config.gold_root)
        for key, value in (("endpoint", store.get("endpoint")), ("access.key", store.get("access_key")), ("secret.key", store.get("secret_key")), ("path.style.access", "true"), ("connection.ssl.enabled", str(bool(store.get("secure"))).lower())):
            if value:
                spark._jsc.hadoopConfiguration().set(f"fs.s3a.{key}", value)
        return Storage(spark, config.raw_root, config.gold_root, store.get("bucket"), store.get("raw_prefix", "raw/"), store.get("gold_prefix", "gold/"))

    def _at(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri.replace("s3://", "s3a://", 1))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, uri: str) -> bool:
        path, fs = self._at(uri)
        return fs.exists(path)

    def ls(self, uri: str) -> list[str]:
        """The files under a folder, however deep, in order; none if there is no such folder."""
        path, fs = self._at(uri)
        if not fs.exists(path):
            return []
        found, files = [], fs.listFiles(path, True)
        while files.hasNext():
            found.append(files.next().getPath().toString())
        return sorted(found)

    def read_bytes(self, uri: str) -> bytes:
        path, fs = self._at(uri)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, uri: str, data: bytes) -> None:
        path, fs = self._at(uri)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def delete(self, uri: str) -> None:
        path, fs = self._at(uri)
        fs.delete(path, True)

    def _path(self, root: str, prefix: str, parts: tuple, remote: bool) -> str:
        if not remote:
            return "/".join([root.rstrip("/"), *parts])
        if not self.bucket:
            raise ValueError("no object store is set up")
        return f"s3a://{self.bucket}/" + "/".join([prefix.strip("/"), *parts])

    def raw_path(self, *parts: str, remote: bool = False) -> str:
        return self._path(self.raw_root, self.raw_prefix, parts, remote)

    def gold_path(self, *parts: str, remote: bool = False) -> str:
        return self._path(self.gold_root, self.gold_prefix, parts, remote)
