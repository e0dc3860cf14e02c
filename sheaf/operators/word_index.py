"""A stored word index that follows merges: unchanging segments, written one a load and put together by size.

Layout: ``segments/<write>`` holds postings sorted by word, ``words/<write>`` their distinct words, ``dead/<write>``
ids that a load has replaced or deleted, ``manifest/<version>.json`` names those that count. Every row
carries the version that wrote it; a posting is dead if a later version lists its id. So an update reads
and writes its own batch only, a search leaves out what has been replaced, and records are never read again.

When :data:`FANOUT` segments are of about one size they are rewritten as one without their dead postings;
so a posting is rewritten a logarithmic number of times, and a search meets a logarithmic number of segments.
Lists of dead ids go once no older segment is left, and are put together when they become many.

As with stored tables, a write counts once its manifest exists, and of two writers at once one fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators.stored_table import DuplicateKeys, conformed
from sheaf.operators.text_search import postings
from sheaf.session import list_names, path_exists, read_text, remove_path, staged, write_new_text

#: Segments of one size, or lists of dead ids, that are put together; rows of the smallest size.
FANOUT, SMALLEST = 4, 1 << 16
#: Parts that the records of one word are dealt out to.
WORD_PARTS = 64

POSTING = "token string, id {id}, tf long, in_title boolean, in_description boolean, written long"


@dataclass
class Segment:
    name: str
    rows: int
    version: int

    @property
    def tier(self) -> int:
        tier, rows = 0, self.rows
        while rows >= SMALLEST:
            tier, rows = tier + 1, rows // FANOUT
        return tier


@dataclass
class Dead:
    name: str
    version: int  # of the newest id in it


@dataclass
class IndexManifest:
    version: int
    id_type: str
    source: int | None = None  # version of the table that the index has followed to
    segments: list[Segment] = field(default_factory=list)
    dead: list[Dead] = field(default_factory=list)


def index_versions(spark: SparkSession, path: str) -> list[int]:
    if not path_exists(spark, f"{path}/manifest/*.json"):
        return []
    return [int(n.removesuffix(".json")) for n in list_names(spark, f"{path}/manifest") if n.endswith(".json")]


def current_index(spark: SparkSession, path: str) -> IndexManifest | None:
    known = index_versions(spark, path)
    if not known:
        return None
    held = json.loads(read_text(spark, f"{path}/manifest/{known[-1]:012d}.json"))
    parts = {"segments": [Segment(**s) for s in held["segments"]], "dead": [Dead(**d) for d in held["dead"]]}
    return IndexManifest(**held | parts)


@dataclass
class WordIndex:
    """The index at ``path`` as one manifest has it; given to a search as its ``index``."""

    spark: SparkSession
    path: str
    manifest: IndexManifest

    def _rows(self, kind: str, names: list[str], schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self, rows: DataFrame) -> DataFrame:
        oldest = min((s.version for s in self.manifest.segments), default=0)
        lists = [d.name for d in self.manifest.dead if d.version > oldest]
        if not lists:
            return rows
        dead = self._rows("dead", lists, f"id {self.manifest.id_type}, written long")
        dead = dead.groupBy(F.col("id").alias("_dead")).agg(F.max("written").alias("_since"))
        return rows.join(dead, (F.col("id") == F.col("_dead")) & (F.col("written") < F.col("_since")), "left_anti")

    def _segments(self, segments: list[Segment]) -> DataFrame:
        return self._rows("segments", [s.name for s in segments], POSTING.format(id=self.manifest.id_type))

    def postings(self) -> DataFrame:
        """``(token, id, tf, in_title, in_description)`` of all records, as of a fresh index."""
        return self._live(self._segments(self.manifest.segments)).drop("written")

    def vocabulary(self) -> DataFrame:
        """Distinct words, among them some that only replaced records held."""
        return self._rows("words", [s.name for s in self.manifest.segments], "token string").distinct()

    def holding(self, words: DataFrame) -> DataFrame:
        """Postings joined to the rows of ``words`` by ``token``. Words are looked up first, and only
        what they find is held against the lists of dead ids."""
        return self._live(self._segments(self.manifest.segments).join(words, "token")).drop("written")


def read_index(spark: SparkSession, path: str) -> WordIndex:
    """The newest state of the index at ``path``."""
    manifest = current_index(spark, path)
    if manifest is None:
        raise ValueError(f"no word index at {path}")
    return WordIndex(spark, path, manifest)


def _write_segment(index: WordIndex, rows: DataFrame, version: int) -> Segment | None:
    """Postings dealt out by word, each word in parts, and sorted by word and id: a common word fills no single
    task, and a word is looked for in few row groups. No sample is drawn, so words are counted once."""
    name = uuid.uuid4().hex
    schema = T.StructType.fromDDL(POSTING.format(id=index.manifest.id_type))
    rows = rows.withColumn("written", F.lit(version).cast("long")).select(*[F.col(f.name).cast(f.dataType) for f in schema])
    rows.repartition("token", F.pmod(F.xxhash64("id"), F.lit(WORD_PARTS))).sortWithinPartitions("token", "id").write.parquet(f"{index.path}/segments/{name}")
    written = index._rows("segments", [name], POSTING.format(id=index.manifest.id_type))
    count = written.count()
    if not count:
        return None
    written.select("token").distinct().write.parquet(f"{index.path}/words/{name}")
    return Segment(name, count, version)


def _write_dead(index: WordIndex, ids: DataFrame, version: int) -> Dead:
    name = uuid.uuid4().hex
    ids.write.parquet(f"{index.path}/dead/{name}")
    return Dead(name, version)


def _put_together(index: WordIndex, chosen: list[Segment]) -> WordIndex:
    """The chosen segments as one of the manifest's version, without postings that are dead by then."""
    manifest = index.manifest
    new = _write_segment(index, index._live(index._segments(chosen)), manifest.version)
    kept = [s for s in manifest.segments if s not in chosen] + ([new] if new else [])
    return replace(index, manifest=replace(manifest, segments=kept))


def _tidied(index: WordIndex, everything: bool = False) -> WordIndex:
    if everything and index.manifest.segments:
        index = _put_together(index, index.manifest.segments)
    while True:
        tiers: dict[int, list[Segment]] = {}
        for s in index.manifest.segments:
            tiers.setdefault(s.tier, []).append(s)
        full = [t for t, own in tiers.items() if len(own) >= FANOUT]
        if not full:
            break
        index = _put_together(index, tiers[min(full)])
    oldest = min((s.version for s in index.manifest.segments), default=index.manifest.version)
    dead = [d for d in index.manifest.dead if d.version > oldest]
    if len(dead) > FANOUT:
        schema = f"id {index.manifest.id_type}, written long"
        ids = index._rows("dead", [d.name for d in dead], schema).groupBy("id").agg(F.max("written").alias("written"))
        dead = [_write_dead(index, ids.filter(F.col("written") > oldest), max(d.version for d in dead))]
    return replace(index, manifest=replace(index.manifest, dead=dead))


def _commit(index: WordIndex) -> WordIndex:
    manifest = index.manifest
    write_new_text(index.spark, f"{index.path}/manifest/{manifest.version:012d}.json", json.dumps(asdict(manifest)))
    return index


def update_index(
    spark: SparkSession,
    path: str,
    records: DataFrame | None = None,
    deleted: DataFrame | None = None,
    source: int | None = None,
) -> WordIndex:
    """Follow a load: ``records`` (id, title, description) replace those of their ids, ids in the first
    column of ``deleted`` go. The index is made if there is none.

    Records are read once. A repeated id is an error, rows without an id are left out, a record without
    words only ends its old postings, and ids that the index does not have change nothing when deleted; an id
    that is given in both is replaced. ``source`` notes the version of the table followed. The same update again changes no result.
    """
    held = current_index(spark, path)
    if held is None and records is None:
        raise ValueError(f"no word index at {path}")
    id_type = held.id_type if held else records.schema["id"].dataType.simpleString()
    version = held.version + 1 if held else 0
    manifest = replace(held, version=version, source=source) if held else IndexManifest(0, id_type, source)
    index = WordIndex(spark, path, manifest)
    typed = T.StructType.fromDDL(f"id {id_type}")
    segments, dead = list(manifest.segments), list(manifest.dead)
    if deleted is not None and held:
        gone = conformed(deleted.select(F.col(deleted.columns[0]).alias("id")).filter("id is not null"), typed).distinct()
        dead.append(_write_dead(index, gone.withColumn("written", F.lit(version).cast("long")), version))
    if records is not None:
        rows = records.filter(F.col("id").isNotNull()).select("id", "title", "description")
        with staged(spark, rows, "indexed") as batch:
            batch = conformed(batch, T.StructType([*typed, *batch.schema.fields[1:]]))
            if not batch.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
                raise DuplicateKeys("the batch repeats an id")
            if held:
                ids = batch.select("id", F.lit(version).cast("long").alias("written"))
                dead.append(_write_dead(index, ids, version))
            new = _write_segment(index, postings(batch), version)
            segments += [new] if new else []
    index = replace(index, manifest=replace(manifest, segments=segments, dead=dead))
    return _commit(_tidied(index))


def compact_index(spark: SparkSession, path: str) -> WordIndex:
    """Rewrite all segments as one and drop all lists of dead ids."""
    index = read_index(spark, path)
    index = replace(index, manifest=replace(index.manifest, version=index.manifest.version + 1))
    return _commit(_tidied(index, everything=True))


def vacuum_index(spark: SparkSession, path: str) -> int:
    """Drop older manifests and folders that the newest does not name. Not to be run beside a search of an
    older state or a writer. Returns how many folders went."""
    manifest = read_index(spark, path).manifest
    used = {s.name for s in manifest.segments} | {d.name for d in manifest.dead}
    gone = 0
    for kind in ("segments", "words", "dead"):
        for name in list_names(spark, f"{path}/{kind}"):
            if name not in used:
                remove_path(spark, f"{path}/{kind}/{name}")
                gone += 1
    for version in index_versions(spark, path)[:-1]:
        remove_path(spark, f"{path}/manifest/{version:012d}.json")
    return gone
