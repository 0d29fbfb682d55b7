"""Immutable table versions and the processing of what changed between them.

A table is a folder of Parquet files that are never rewritten, and one manifest
for each version: which files it adds and removes and, where single rows are
deleted, a deletion vector (row positions). Every ``SNAPSHOT`` versions a
manifest lists the whole table. The difference of two manifests therefore names
all changed records without reading unchanged files.

A commit is made on a base version and fails if another writer has committed
since, so nothing is decided on rows that are no longer the newest. A consumer
saves the source version it has handled in the manifest of its own output
commit. The manifest appears by one atomic step, so a run that fails at any
moment leaves neither half an output nor a wrong position: the next run starts
from the last version that was committed together with its result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE, POSITION = "_file", "_position"
#: Versions from one full list of files to the next, and times that a write is begun anew after a conflict.
SNAPSHOT, TRIES = 50, 20
T = TypeVar("T")


class CommitConflict(RuntimeError):
    """Another writer has committed this version already."""


class VersionedTable:
    """Versions of a table at ``path``, on any file system that Spark can write and that renames atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._known: dict[int, dict] = {}

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # manifests

    def versions(self) -> list[int]:
        """Committed versions, ascending; empty for a table that doesn't exist yet."""
        where = self._at("_versions")
        if not self._fs.exists(where):
            return []
        names = (str(s.getPath().getName()) for s in self._fs.listStatus(where))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def step(self, version: int) -> dict:
        """What a version changes: ``{version, added, removed, vectors, schema, about, rewrite}``."""
        if version not in self._known:
            stream = self._fs.open(self._at(f"_versions/{version}.json"))
            try:
                self._known[version] = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._known[version]

    def manifest(self, version: int) -> dict:
        """``{version, files, deleted, schema, about}``; version 0 is the empty table."""
        steps, at = [], version
        while at > 0 and "files" not in self.step(at):
            steps.append(self.step(at))
            at -= 1
        full = self.step(at) if at else {"files": [], "deleted": [], "schema": None, "about": {}}
        files, deleted = dict.fromkeys(full["files"]), dict.fromkeys(full["deleted"])
        for s in reversed(steps):
            for f in s["removed"]:
                files.pop(f, None)
            files |= dict.fromkeys(s["added"])
            deleted = {} if s["rewrite"] else deleted
            deleted |= dict.fromkeys(s["vectors"])
        last = steps[0] if steps else full
        return {"version": version, "files": list(files), "deleted": list(deleted), "schema": last["schema"], "about": last["about"]}

    def latest(self) -> dict:
        """Manifest of the newest version."""
        return self.manifest(max(self.versions(), default=0))

    def _publish(self, manifest: dict) -> int:
        """Make a version visible: write aside, then give it its name, in one step that fails if the name is taken."""
        target = self._at(f"_versions/{manifest['version']}.json")
        aside = self._at(f"_staged/{uuid.uuid4().hex}.json")
        self._fs.mkdirs(self._at("_versions"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._named(aside, target):
            self._fs.delete(aside, False)
            raise CommitConflict(f"version {manifest['version']} exists already")
        return manifest["version"]

    def _named(self, aside, target) -> bool:
        """Whether the file got its name. On a local disk a rename may overwrite; a hard link never does."""
        rename = lambda: not self._fs.exists(target) and bool(self._fs.rename(aside, target))
        if str(self._fs.getUri().getScheme()) != "file":
            return rename()
        nio, path = self.spark.sparkContext._jvm.java.nio.file, lambda p: self.spark.sparkContext._jvm.java.io.File(str(p.toUri().getPath())).toPath()
        try:
            nio.Files.createLink(path(self._fs.makeQualified(target)), path(self._fs.makeQualified(aside)))
        except Exception as e:  # noqa: BLE001  raised by the JVM
            return False if "FileAlreadyExists" in str(e) else rename()  # a mounted folder may know no links
        self._fs.delete(aside, False)
        return True

    # writing

    def _files(self, folder: str) -> list[str]:
        found, base = self._fs.listFiles(self._at(folder), True), len(str(self._fs.makeQualified(self._at("")))) + 1
        names = []
        while found.hasNext():
            name = str(found.next().getPath())[base:]
            if name.endswith(".parquet"):
                names.append(name)
        return sorted(names)

    def commit(self, add: DataFrame | None = None, remove_files: tuple[str, ...] = (), delete: DataFrame | None = None, about: dict | None = None, rewrite: bool = False, base: dict | None = None) -> int:
        """Commit a version with added rows, removed files and single deleted rows.

        ``base`` is the manifest that the change was made for (default: the
        newest). If another version was committed since, what was written is
        taken away and :class:`CommitConflict` raised.

        ``rewrite`` says that the rows are those of the version before in other
        files, with its deletion vectors applied: no record has changed.

        ``delete`` holds ``(_file, _position)`` as given by :meth:`read` with
        ``positions=True``. It is stored as a file of its own, one deletion
        vector for all files of the commit. Deleting a row twice, or naming a
        file that isn't there, changes nothing.
        """
        old = self.latest() if base is None else base
        version, written = old["version"] + 1, []
        added, vectors = [], []
        if add is not None:
            written.append(f"data/{uuid.uuid4().hex}")
            add.write.parquet(f"{self.path}/{written[-1]}")
            added = self._files(written[-1])
        if delete is not None:
            vectors = [f"deleted/{uuid.uuid4().hex}"]
            written += vectors
            delete.select(FILE, POSITION).distinct().write.parquet(f"{self.path}/{vectors[0]}")
        new = {
            "version": version, "added": added, "removed": sorted(set(remove_files) & set(old["files"])), "vectors": vectors, "rewrite": rewrite,
            "schema": add.schema.json() if add is not None else old["schema"], "about": about if about is not None else old["about"],
        }
        if version % SNAPSHOT == 0:
            gone = set(new["removed"])
            new |= {"files": [f for f in old["files"] if f not in gone] + added, "deleted": ([] if rewrite else old["deleted"]) + vectors}
        try:
            return self._publish(new)
        except CommitConflict:
            for folder in written:
                self._fs.delete(self._at(folder), True)
            raise

    def retry(self, write: Callable[[dict], T], tries: int = TRIES) -> T:
        """``write(base)`` with the newest manifest, begun anew as long as another writer commits in between."""
        for _ in range(tries - 1):
            try:
                return write(self.latest())
            except CommitConflict:
                continue
        return write(self.latest())

    def compact(self) -> int:
        """Rewrite all files into new ones without the deleted rows."""
        return self.retry(lambda base: self.commit(add=self.read(base["version"]), remove_files=tuple(base["files"]), rewrite=True, base=base))

    def commit_each(self, df: DataFrame, version: str, count: int, about: Callable[[int], dict] = lambda _: {}) -> None:
        """Commit ``count`` versions at once, that of a row being in column ``version`` (1 to ``count``).

        One write job makes the files of all versions (rebalanced by version, so
        that a version with most of the rows gets many files); then the
        manifests, each with its own files only, are published in order. A
        version may add no rows.
        """
        base, folder = self.latest(), f"data/{uuid.uuid4().hex}"
        df.hint("rebalance", version).write.partitionBy(version).parquet(f"{self.path}/{folder}")
        made: dict[int, list[str]] = {}
        for name in self._files(folder):
            made.setdefault(int(name.split(f"{version}=")[1].split("/")[0]), []).append(name)
        files, schema = list(base["files"]), df.drop(version).schema.json()
        for v in range(1, count + 1):
            files += made.get(v, [])
            new = {"version": base["version"] + v, "added": made.get(v, []), "removed": [], "vectors": [], "rewrite": False, "schema": schema, "about": about(v)}
            if new["version"] % SNAPSHOT == 0:
                new |= {"files": files, "deleted": base["deleted"]}
            self._publish(new)

    # reading

    def _load(self, schema: str, files: list[str], positions: bool) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not files:
            df = self.spark.createDataFrame([], kind)
            return df.withColumns({FILE: F.lit(""), POSITION: F.lit(0).cast("long")}) if positions else df
        df = self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in files])
        return df.select("*", self._inside().alias(FILE), F.col("_metadata.row_index").alias(POSITION)) if positions else df

    def _inside(self):
        """Path of the file of a row, below that of the table."""
        plain = str(self._fs.makeQualified(self._at("")).toUri().getPath())
        return F.substring(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/+", "/"), len(plain) + 2, 10_000)

    def _gone(self, vectors: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{FILE} string, {POSITION} long").parquet(*[f"{self.path}/{v}" for v in vectors])

    def read(self, version: int | None = None, positions: bool = False) -> DataFrame:
        """Rows of a version (default: the newest), less its deleted rows."""
        m = self.latest() if version is None else self.manifest(version)
        df = self._load(m["schema"], m["files"], positions or bool(m["deleted"]))
        if m["deleted"]:
            df = df.join(self._gone(m["deleted"]), [FILE, POSITION], "left_anti")
        return df if positions else df.drop(FILE, POSITION)

    def diff(self, old: int, new: int) -> DataFrame:
        """Rows that differ between two versions, with ``_change`` 'added' or 'removed'.

        Reads added and removed files, and of the others only those that a
        deletion vector of a newer version names. A row that came and went in
        between isn't told.
        """
        a, b = self.manifest(old), self.manifest(new)
        steps = [self.step(v) for v in range(old + 1, new + 1)]
        if any(s["rewrite"] for s in steps):
            parts = [self.diff(s["version"] - 1, s["version"]) for s in steps if not s["rewrite"]]
            return reduce(DataFrame.unionByName, parts) if parts else self._load(b["schema"], [], False).withColumn("_change", F.lit(""))
        came, went = sorted(set(b["files"]) - set(a["files"])), sorted(set(a["files"]) - set(b["files"]))
        stay = sorted(set(a["files"]) & set(b["files"]))
        fresh = [v for v in b["deleted"] if v not in set(a["deleted"])]
        added, removed = self._load(b["schema"], came, True), self._load(b["schema"], went, True)
        if fresh and came:
            added = added.join(self._gone(fresh), [FILE, POSITION], "left_anti")
        if a["deleted"] and went:
            removed = removed.join(self._gone(a["deleted"]), [FILE, POSITION], "left_anti")
        if fresh and stay:
            named = {r[0] for r in self._gone(fresh).select(FILE).distinct().collect()}  # bounded by the files of the table
            lost = self._load(b["schema"], [f for f in stay if f in named], True).join(self._gone(fresh), [FILE, POSITION], "left_semi")
            if a["deleted"]:
                lost = lost.join(self._gone(a["deleted"]), [FILE, POSITION], "left_anti")
            removed = removed.unionByName(lost)
        mark = lambda df, what: df.drop(FILE, POSITION).withColumn("_change", F.lit(what))
        return mark(added, "added").unionByName(mark(removed, "removed"))

    def changes(self, old: int, new: int, name: str = "_version") -> DataFrame:
        """What each version after ``old``, up to ``new``, changes: its rows with ``_change`` and the version in ``name``.

        One plan for all versions: every file that a version adds or removes is
        read once and labelled from the manifests, and so are the rows that
        their deletion vectors name. Rewrites change nothing.
        """
        steps = [self.step(v) for v in range(old + 1, new + 1)]
        before, schema = self.manifest(old), self.manifest(new)["schema"]
        steps = [s for s in steps if not s["rewrite"]]

        def told(label: list[tuple[str, int]], what: str) -> DataFrame:
            rows = self._load(schema, [f for f, _ in label], True)
            names = self.spark.createDataFrame(label, f"{FILE} string, {name} int")
            return rows.join(names, FILE).withColumn("_change", F.lit(what))

        parts = [told([(f, s["version"]) for s in steps for f in s["added"]], "added")]
        removed = [(f, s["version"]) for s in steps for f in s["removed"]]
        vectors = [(v, s["version"]) for s in steps for v in s["vectors"]]
        held = list(dict.fromkeys([*before["deleted"], *[v for v, _ in vectors]]))
        if removed:
            gone = told(removed, "removed")
            parts.append(gone.join(self._gone(held), [FILE, POSITION], "left_anti") if held else gone)
        if vectors:
            where = self.spark.createDataFrame(vectors, f"_vector string, {name} int")
            lost = self._gone([v for v, _ in vectors]).select(FILE, POSITION, F.regexp_extract(self._inside(), "^(deleted/[0-9a-f]+)", 1).alias("_vector"))
            lost = lost.join(where, "_vector").groupBy(FILE, POSITION).agg(F.min(name).alias(name))
            if before["deleted"]:
                lost = lost.join(self._gone(before["deleted"]), [FILE, POSITION], "left_anti")
            named = {r[0] for r in lost.select(FILE).distinct().collect()}  # bounded by the files of the table
            known = dict.fromkeys([*before["files"], *[f for v in range(old + 1, new + 1) for f in self.step(v)["added"]]])
            rows = self._load(schema, [f for f in known if f in named], True)
            parts.append(rows.join(lost, [FILE, POSITION]).withColumn("_change", F.lit("removed")))
        return reduce(DataFrame.unionByName, [p.drop(FILE, POSITION) for p in parts])


def changed_keys(deltas: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """``(version, key, top)`` of the keys that are new in a version or whose greatest ``order``, told as ``top``, grew in it.

    ``deltas`` are the rows added by each version. Null keys are left out; a
    null ``order`` counts as the lowest value. Rows are first reduced to one
    for each key and version, so a key that holds a third of all rows is as
    cheap as any other.
    """
    lowest = F.lit(-(2**63))
    best = deltas.where(F.col(key).isNotNull()).groupBy(key, version).agg(F.max(F.coalesce(F.col(order), lowest)).alias("top"))
    before = F.max("top").over(Window.partitionBy(key).orderBy(version).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("top") > F.col("_before"))).select(version, key, "top")


def process_new(source: VersionedTable, sink: VersionedTable, transform: Callable[[DataFrame], DataFrame], consumer: str = "default", each: bool = False) -> int | None:
    """Run ``transform`` over what changed in ``source`` since the last success, and commit its result.

    ``transform`` gets :meth:`VersionedTable.diff`, or with ``each``
    :meth:`VersionedTable.changes`, from the version handled last to the newest.
    The handled version is part of the output's commit, and that holds only if
    the sink is still as it was when the position was read: of two workers of a
    consumer one has to begin anew, and no record is handled twice. Returns the
    sink's new version, or None if there is nothing new. A crash before the
    commit leaves the sink as it was; the same rows are handled by the next run.
    """

    def attempt(base: dict) -> int | None:
        position, now = int(base["about"].get(consumer, 0)), max(source.versions(), default=0)
        if now == position:
            return None
        delta = (source.changes if each else source.diff)(position, now)
        return sink.commit(add=transform(delta), about={**base["about"], consumer: now}, base=base)

    return sink.retry(attempt)
