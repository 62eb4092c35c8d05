"""A Parquet table that grows by key: small batches touch few of its files.

Rows lie in buckets by a hash of their key. A batch is one new *version*: a folder of the
buckets it touched, and then a manifest that says, for every bucket, which folders hold
its rows. A batch reads the touched buckets only, so its cost follows the batch
and not the history. A bucket is appended to until ``most_parts`` folders hold it, then
the next batch that touches it writes it anew as one.

A version counts from the moment its manifest is there, so a reader sees a batch whole or
not at all. The newest manifest names the batch that made it: when that batch runs again
after a failure, its version is made anew on top of the same earlier one, whatever was
left behind. One writer at a time is assumed, as for any streaming sink.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKET = "_bucket"


@dataclass(frozen=True)
class Manifest:
    """State of the table after a version: for each bucket the versions that hold its rows."""

    version: int
    run: str
    batch: int
    buckets: int
    parts: dict[int, list[int]] = field(default_factory=dict)


@dataclass(frozen=True)
class KeyedTable:
    path: str
    key: tuple[str, ...]
    schema: str  # DDL of the rows
    buckets: int = 64
    most_parts: int = 16
    direct: bool = False  # the key is a small whole number and names the bucket itself

    # -- manifests ---------------------------------------------------------------------

    def _folder(self, spark: SparkSession, *names: str):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *names)))
        return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _versions(self, spark: SparkSession) -> list[int]:
        store, folder = self._folder(spark, "manifest")
        if not store.exists(folder):
            return []
        names = (status.getPath().getName() for status in store.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _manifest(self, spark: SparkSession, version: int) -> Manifest:
        text = "\n".join(r.value for r in spark.read.text(f"{self.path}/manifest/{version:010d}.json").collect())
        held = json.loads(text)
        held["parts"] = {int(b): parts for b, parts in held["parts"].items()}
        found = Manifest(**held)
        if found.buckets != self.buckets:
            raise ValueError(f"{self.path} has {found.buckets} buckets, not {self.buckets}")
        return found

    def latest(self, spark: SparkSession) -> Manifest:
        versions = self._versions(spark)
        return self._manifest(spark, versions[-1]) if versions else Manifest(0, "", -1, self.buckets)

    def base(self, spark: SparkSession, run: str, batch: int) -> Manifest:
        """What the batch builds on: the newest version that this very batch has not made."""
        newest = self.latest(spark)
        if newest.version and (newest.run, newest.batch) == (run, batch):
            earlier = [v for v in self._versions(spark) if v < newest.version]
            return self._manifest(spark, earlier[-1]) if earlier else Manifest(0, "", -1, self.buckets)
        return newest

    def _commit(self, spark: SparkSession, manifest: Manifest) -> None:
        store, target = self._folder(spark, "manifest", f"{manifest.version:010d}.json")
        _, draft = self._folder(spark, "manifest", f".{manifest.version:010d}.draft")
        stream = store.create(draft, True)
        stream.write(json.dumps(manifest.__dict__).encode())
        stream.close()
        store.delete(target, False)
        if not store.rename(draft, target):
            raise OSError(f"cannot write {target}")

    # -- reading -----------------------------------------------------------------------

    def bucket(self):
        if self.direct:
            return F.col(self.key[0]).cast("int")
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def files(self, manifest: Manifest, buckets: Sequence[int] | None = None) -> list[str]:
        chosen = sorted(manifest.parts) if buckets is None else [b for b in buckets if b in manifest.parts]
        return [f"{self.path}/data/version={v}/{BUCKET}={b}" for b in chosen for v in manifest.parts[b]]

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Rows of the newest (or the given) version, of all or of some buckets."""
        files = self.files(manifest or self.latest(spark), buckets)
        if not files:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*files)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the keys of ``rows`` lie in; as many numbers as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys, read from their buckets alone."""
        named = keys.select(*self.key).distinct()
        held = self.read(keys.sparkSession, self.touched(named))
        return held.join(named, list(self.key), "left_semi")

    # -- writing -----------------------------------------------------------------------

    def _write(self, rows: DataFrame, base: Manifest, run: str, batch: int, rewritten: Sequence[int]) -> Manifest:
        """A version of ``rows`` (with their bucket): added to their buckets, or in place of ``rewritten`` ones."""
        spark = rows.sparkSession
        version = base.version + 1
        place = f"{self.path}/data/version={version}"
        # a bucket in one or, where it is large, some tasks, instead of a file from each task
        rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(place)
        store, folder = self._folder(spark, "data", f"version={version}")
        numbers = [_numbered(status.getPath().getName(), BUCKET) for status in store.listStatus(folder)]
        written = [n for n in numbers if n is not None]
        parts = {b: list(p) for b, p in base.parts.items() if b not in set(rewritten)}
        for b in written:
            parts.setdefault(b, []).append(version)
        made = Manifest(version, run, batch, self.buckets, parts)
        self._commit(spark, made)
        return made

    def vacuum(self, spark: SparkSession, keep: int = 20) -> int:
        """Delete bucket folders that none of the ``keep`` newest versions holds, and older manifests.

        Readers of an older version lose it; the newest ones and the batch that may run again keep
        theirs, so ``keep`` is 2 at least. Returns the number of bucket folders deleted.
        """
        if keep < 2:
            raise ValueError("a batch that runs again needs the version before its own")
        versions = self._versions(spark)
        if not versions:
            return 0
        needed = set()
        for version in versions[-keep:]:
            needed |= {(v, b) for b, parts in self._manifest(spark, version).parts.items() for v in parts}
        store, folder = self._folder(spark, "data")
        deleted = 0
        for made in store.listStatus(folder):
            version = _numbered(made.getPath().getName(), "version")
            if version is None or version > versions[-1]:  # being written
                continue
            for status in store.listStatus(made.getPath()):
                bucket = _numbered(status.getPath().getName(), BUCKET)
                if bucket is not None and (version, bucket) not in needed:
                    deleted += store.delete(status.getPath(), True)
        for version in versions[:-keep]:
            store.delete(self._folder(spark, "manifest", f"{version:010d}.json")[1], False)
        return deleted

    def insert_if_absent(self, new: DataFrame, run: str, batch: int, arrival: Sequence[str]) -> Manifest:
        """Append the first arrival of each key the table lacks; NULL keys never conflict.

        Only the key column of the touched buckets is read. Rows without a key are dealt by all
        their columns, so many of them do not meet in one bucket.
        """
        from streamwarden.operators.sinks import insert_if_absent

        if len(self.key) != 1:
            raise ValueError("insert_if_absent takes a single key column")
        key = self.key[0]
        base = self.base(new.sparkSession, run, batch)
        columns = [F.col(c) for c in new.columns]
        dealt = F.when(F.col(key).isNotNull(), self.bucket()).otherwise(
            F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")
        )
        marks = new.select(dealt, F.col(key).isNotNull()).distinct().collect()  # two rows a bucket at most
        held = self.read(new.sparkSession, sorted(b for b, keyed in marks if keyed), base)
        fresh = insert_if_absent(new, held.select(key), key, arrival).withColumn(BUCKET, dealt)
        full = sorted({b for b, _ in marks if len(base.parts.get(b, ())) >= self.most_parts})
        if full:
            fresh = fresh.unionByName(self.read(new.sparkSession, full, base).withColumn(BUCKET, self._own_bucket(full)))
        return self._write(fresh, base, run, batch, full)

    def append(self, new: DataFrame, run: str, batch: int) -> Manifest:
        """Add rows as they are."""
        return self._write(new.withColumn(BUCKET, self.bucket()), self.base(new.sparkSession, run, batch), run, batch, ())

    def _own_bucket(self, full: Sequence[int]):
        """The bucket a stored row was read from: its folder says so, whatever its key."""
        return F.regexp_extract(F.input_file_name(), rf"{BUCKET}=(\d+)/", 1).cast("int")

    def upsert(
        self, new: DataFrame, run: str, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]
    ) -> Manifest:
        """Replace the touched buckets by ``merge(held, new)``, both of whole buckets.

        ``merge`` must keep held rows that have no counterpart and must not move keys.
        """
        base = self.base(new.sparkSession, run, batch)
        touched = self.touched(new)
        held = self.read(new.sparkSession, touched, base)
        merged = merge(held, new).withColumn(BUCKET, self.bucket())
        return self._write(merged, base, run, batch, touched)


def _numbered(name: str, prefix: str) -> int | None:
    """The number in a folder's name such as ``version=7``."""
    head, _, number = name.partition("=")
    return int(number) if head == prefix and number.isdigit() else None


def replace_rows(*key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge in which new rows take the place of held ones with their key."""

    def merge(held: DataFrame, new: DataFrame) -> DataFrame:
        return held.join(new.select(*key), list(key), "left_anti").select(*new.columns).unionByName(new)

    return merge


def add_rows(held: DataFrame, new: DataFrame) -> DataFrame:
    """A merge of sets: rows that are there already are not added again."""
    return held.unionByName(new).distinct()
