"""Versioned publication: tables go to a directory of their own, then one numbered pointer names it.

Readers follow the pointer of the greatest number, so they see all tables of one version or of the one
before; a failed writer leaves a directory that nothing names, which sweep() removes once it is old
enough not to be one that is being written. A pointer file is created or the call fails, so of two
writers that start from one version only one succeeds: no lock is needed, and a reader's role is not to publish.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import in_order


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


class Busy(RuntimeError):
    """Another operation of this session is under way on the same tables; kind says which."""

    def __init__(self, kind: str) -> None:
        super().__init__(f"busy: {kind}")
        self.kind = kind


@dataclass(frozen=True)
class Role:
    """What a session may do: a producer maintains the index and its vectors, a companion reads and searches."""

    producer: bool = True

    @property
    def profile(self) -> str:
        return "desktop" if self.producer else "mobile"

    def must_write(self) -> None:
        if not self.producer:
            raise PermissionError("a companion reads and searches; it doesn't maintain the index")


@dataclass(frozen=True)
class Pointer:
    number: int
    version: str
    tables: tuple[str, ...]
    manifest: dict


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_file(spark: SparkSession, path: str, content: bytes, overwrite: bool = False) -> None:
    """A small file; unless it may overwrite, it fails where there is one already."""
    p, fs = _fs(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def pointer(spark: SparkSession, root: str) -> Pointer | None:
    """The newest pointer, or None before the first."""
    names = [n for n in names_in(spark, f"{root}/pointers") if n.endswith(".json")]
    if not names:
        return None
    said = json.loads(read_file(spark, f"{root}/pointers/{names[-1]}"))
    return Pointer(int(names[-1].removesuffix(".json")), said["version"], tuple(said["tables"]), said["manifest"])


def current(spark: SparkSession, root: str) -> str | None:
    """The newest version's name, or None before the first."""
    now = pointer(spark, root)
    return now and now.version


def _publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], sort_by: dict[str, str] | None, manifest: dict | None, since: Pointer | None | bool, drop: Iterable[str] = ()) -> Pointer:
    before = pointer(spark, root)
    if since is not False and since != before:
        raise Conflict(f"{root} has changed")
    version, rows = uuid.uuid4().hex, {}
    for name, df in tables.items():
        key, path = (sort_by or {}).get(name), f"{root}/versions/{version}/{name}"
        order = in_order(F.col(key)) if key and df.schema[key].dataType.typeName() == "string" else [F.col(key)] if key else []
        (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.option("compression", "zstd").parquet(path)  # texts take half the usual space
        rows[name] = spark.read.schema(df.schema).parquet(path).count()  # from the files' footers
    kept, gone = {} if before is None else before.manifest, set(drop)
    stays = lambda section: {k: v for k, v in kept.get(section, {}).items() if k not in gone}
    where = stays("where") | {name: version for name in tables}
    said = {"version": version, "tables": sorted(where), "manifest": kept | (manifest or {}) | {"where": where, "rows": stays("rows") | rows}}
    number = (before.number if before else 0) + 1
    try:
        write_file(spark, f"{root}/pointers/{number:012d}.json", json.dumps(said).encode())
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{root} has changed") from e
        raise
    return Pointer(number, version, tuple(said["tables"]), json.loads(json.dumps(said["manifest"])))


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], sort_by: dict[str, str] | None = None, manifest: dict | None = None, since: Pointer | None | bool = False) -> str:
    """Write the tables as a new version and point to it; returns its name. The pointer is written last.

    manifest: sections to set; those of the version before stay otherwise, as do its tables that aren't
    given; rows of every table are counted in it. sort_by: a column for each table that is to be in its order, texts as readers sort them. since: the pointer that the tables were made from; if another one is
    newest by then, Conflict is raised and nothing is published. Operations of several steps use a writer().
    """
    return _publish(spark, root, tables, sort_by, manifest, since).version


#: Operations of this session, by root.
_under_way: dict[str, list[str]] = {}


@dataclass
class Writer:
    """One operation on the tables in root; since is the version it reads and builds on."""

    spark: SparkSession
    root: str
    kind: str
    since: Pointer | None

    def has(self, table: str) -> bool:
        return self.since is not None and table in self.since.manifest["where"]

    def read(self, table: str) -> DataFrame:
        return _read(self.spark, self.root, self.since, table)

    def publish(self, tables: dict[str, DataFrame], sort_by: dict[str, str] | None = None, manifest: dict | None = None, drop: Iterable[str] = ()) -> Pointer:
        """Publish tables on top of since, which moves on; Conflict if anyone else has published meanwhile. drop: tables that the new version doesn't have."""
        self.since = _publish(self.spark, self.root, tables, sort_by, manifest, self.since, drop)
        return self.since


@contextmanager
def writer(spark: SparkSession, root: str, kind: str, role: Role = Role()) -> Iterator[Writer]:
    """A Writer for an operation of a kind. Raises PermissionError for a companion, Busy while another operation of this session holds root.

    Its jobs carry the kind as a tag, so that cancelling the tag ends them; what they would have published is never pointed to.
    """
    role.must_write()
    mine = [kind]
    if (holder := _under_way.setdefault(root, mine)) is not mine:  # one step, whatever other threads do
        raise Busy(holder[0])
    spark.addTag(kind)
    try:
        yield Writer(spark, root, kind, pointer(spark, root))
    finally:
        spark.removeTag(kind)
        del _under_way[root]


@contextmanager
def staged(spark: SparkSession, root: str) -> Iterator[str]:
    """A folder in root for tables that an operation pins down for itself; it is removed at the end."""
    path, fs = _fs(spark, f"{root}/staged/{uuid.uuid4().hex}")
    try:
        yield path.toString()
    finally:
        fs.delete(path, True)


def _read(spark: SparkSession, root: str, now: Pointer | None, table: str) -> DataFrame:
    if now is None or table not in now.manifest["where"]:
        raise LookupError(f"nothing of that name is published in {root}: {table}")
    return spark.read.parquet(f"{root}/versions/{now.manifest['where'][table]}/{table}")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return _read(spark, root, pointer(spark, root), table)


def activate(spark: SparkSession, root: str, views: dict[str, str]) -> None:
    """Point temporary views (name to table) at the newest version, after it is published."""
    for view, table in views.items():
        read(spark, root, table).createOrReplaceTempView(view)


def validate_records(records: DataFrame, chunks: DataFrame, dimensions: int) -> DataFrame:
    """One row of checks that a publication must pass: unique ids, dimensions, known chunks."""
    known = records.join(chunks.select("chunk_id"), "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    own = records.agg(F.count(F.lit(1)).alias("records"), (F.count(F.lit(1)) - F.count_distinct("chunk_id")).alias("duplicates"), F.count_if(F.size("embedding") != dimensions).alias("wrong_dimensions"))
    return own.crossJoin(known).withColumn("valid", F.expr("duplicates = 0 and wrong_dimensions = 0 and unknown = 0"))  # one row each


def publish_records(own: Writer, records: DataFrame, chunks: DataFrame, identity: dict, manifest: dict | None = None, drop: Iterable[str] = ()) -> Pointer:
    """Publish vector records, sorted by chunk_id, with their identity in the manifest; records that don't pass the checks raise ValueError."""
    checks = validate_records(records, chunks, identity["dimensions"]).first()
    if not checks.valid:
        raise ValueError(f"records are not fit to be published: {checks.asDict()}")
    said = {"embeddings": identity | {"total": checks.records, "publication_id": uuid.uuid4().hex}}
    return own.publish({"embeddings": records}, {"embeddings": "chunk_id"}, (manifest or {}) | said, drop)


def maintain_copy(spark: SparkSession, root: str, copied_id, copy) -> str | None:
    """Bring a derived copy of the published vectors up to date; returns the publication it stands for now.

    copied_id() tells which publication the copy is of; copy(records, manifest) makes it. A copy of the
    newest publication is left alone. A publication that comes while the copy is made supersedes it: the
    copy is made again, of the newest.
    """
    while True:
        now = pointer(spark, root)
        said = None if now is None else now.manifest.get("embeddings")
        if said is None or copied_id() == said["publication_id"]:
            return said and said["publication_id"]
        copy(read(spark, root, "embeddings"), said)


def sweep(spark: SparkSession, root: str, least_age_s: float = 24 * 3600) -> list[str]:
    """Remove versions that the newest pointer doesn't name and that were last written so long ago; returns their names."""
    now = pointer(spark, root)
    keep = set() if now is None else set(now.manifest["where"].values())
    folder, fs = _fs(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []

    def newest(path) -> int:
        # What is being written may be deep below a folder that was made long ago.
        found, files = 0, fs.listFiles(path, True)
        while files.hasNext():
            found = max(found, files.next().getModificationTime())
        return found

    statuses = [s for s in fs.listStatus(folder) if s.getPath().getName() not in keep]
    gone = [s.getPath() for s in statuses if max(s.getModificationTime(), newest(s.getPath())) / 1000 <= time.time() - least_age_s]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)
