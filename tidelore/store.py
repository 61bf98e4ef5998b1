"""A store: versioned Parquet tables and a manifest table that names the current version.

Every change writes new files and then a manifest row; readers see a version whole or not at all. Writers must be
serialised by the caller (the stream and the server do so).
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.text import normalize_text
from .operators import artifacts, dictionary, extract, ingest
from .operators.resume import resume
from .operators.search import search

TURNS = "turn_id long, session_id string, seq long, role string, content string, created_at string, raw_bytes long, estimated_tokens long, sha256 string"
ATOMS = "turn_id long, role string, rank int, kind string, content string, confidence double, authority double"
ATTACHMENTS = "attachment_id long, filename string, mime_type string, media_type string, raw_bytes long, sha256 string, sidecar_text string, source_turn_id long, payload binary"
SESSIONS = "session_id string, title string, created_at string"
ENTRIES = "entry_id long, kind string, content string, confidence double, authority double, status string, version int, fingerprint string, source_turn_id long, supersedes_id long"
TABLES = {"turns": TURNS, "atoms": ATOMS, "attachments": ATTACHMENTS, "sessions": SESSIONS}
MANIFEST = "version long, title string, codec string, block_turns int, folders map<string,array<string>>, meta map<string,string>"
SKETCH_BYTES = 64
CODECS = {"none": "none", "zlib": "gzip", "zlib9": "gzip", "zstd": "zstd", "snappy": "snappy", "lz4": "lz4"}


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, title: str = "Untitled", codec: str = "zstd", overwrite: bool = False, block_turns: int = ingest.BLOCK_TURNS) -> Store:
        if codec not in CODECS:
            raise ValueError(f"unknown codec {codec}")
        s = cls(spark, path)
        row = spark.createDataFrame([(0, title, codec, block_turns, {}, {})], MANIFEST)
        row.write.mode("overwrite" if overwrite else "errorifexists").json(f"{s.path}/manifest")
        s._commit({"sessions": [s._write(spark.createDataFrame([("main", title, _now())], SESSIONS), "sessions")]})
        return s

    # ---- versions ----

    def manifest(self):
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        return rows.orderBy(F.desc("version")).first()

    def _write(self, df: DataFrame, table: str) -> str:
        folder = f"{table}/{uuid.uuid4().hex}"
        df.write.option("compression", CODECS[self.manifest()["codec"]]).parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, added: dict[str, list[str]], replace: bool = False, meta: dict[str, str] | None = None) -> None:
        m = self.manifest()
        old = {t: f for t, f in (m["folders"] or {}).items() if t in TABLES or t in added}
        folders = {t: ([] if replace or t not in TABLES else list(old.get(t, []))) + added.get(t, []) for t in {*old, *added}}
        row = self.spark.createDataFrame([(m["version"] + 1, m["title"], m["codec"], m["block_turns"], folders, {**(m["meta"] or {}), **(meta or {})})], MANIFEST)
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def table(self, name: str) -> DataFrame:
        folders = (self.manifest()["folders"] or {}).get(name, [])
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def set_meta(self, key: str, value: str) -> None:
        self._commit({}, meta={key: value})

    def meta(self, key: str, default: str = "") -> str:
        return (self.manifest()["meta"] or {}).get(key, default)

    # ---- writing ----

    def new_session(self, title: str = "") -> str:
        name = uuid.uuid4().hex[:12]
        self._commit({"sessions": [self._write(self.spark.createDataFrame([(name, title, _now())], SESSIONS), "sessions")]})
        return name

    def append(self, items: DataFrame) -> int:
        """Adds items (session_id, pos, role, content, created_at, extract); returns how many turns are new."""
        return self.import_items(items)["new_turns"]

    def import_items(self, items: DataFrame) -> dict[str, int]:
        """Adds items and sums up: turns with a text (known ones too), new turns, atoms of the new turns."""
        unknown = items.select("session_id").distinct().join(self.table("sessions"), "session_id", "left_anti").first()
        if unknown is not None:
            raise KeyError(f"unknown session {unknown['session_id']}")
        new = ingest.number_turns(items, self.table("turns"))
        folder = self._write(new.withColumn("created_at", F.coalesce("created_at", F.lit(_now()))), "turns")
        rows = self.spark.read.schema(TURNS + ", extract boolean").parquet(f"{self.path}/{folder}")
        atoms = extract.atoms(rows.filter("extract"), ["turn_id"]).withColumn("authority", F.lit(None).cast("double"))
        found = self._write(_typed(atoms, ATOMS), "atoms")
        self._commit({"turns": [folder], "atoms": [found]})
        n_atoms = self.spark.read.schema(ATOMS).parquet(f"{self.path}/{found}").count()
        return {"turns": items.filter(normalize_text(F.col("content")) != "").count(), "new_turns": rows.count(), "atoms": n_atoms}

    def append_turn(self, role: str, content: str, session_id: str = "main", extract_atoms: bool = True) -> int:
        self.append(self.spark.createDataFrame([(session_id, 0, role, content, None, extract_atoms)], "session_id string, pos long, role string, content string, created_at string, extract boolean"))
        from .functions.text import fingerprint, normalize_role, with_normalized

        key = with_normalized(self.spark.createDataFrame([(role, content)], "role string, content string"), "content", "n").select(normalize_role(F.col("role")).alias("role"), fingerprint(F.col("n")).alias("sha256"))
        return self.table("turns").filter(F.col("session_id") == session_id).join(key, ["role", "sha256"]).first()["turn_id"]

    def add_entry(self, kind: str, content: str, session_id: str = "main", source_turn_id: int | None = None) -> int:
        """A manual entry of full authority; without a source it leaves a system turn. Returns its id, -1 if it is not active."""
        from .functions.constants import KIND_PRIORITY

        if kind not in KIND_PRIORITY:
            raise ValueError(f"unknown kind {kind}")
        turn = source_turn_id or self.append_turn("system", f"Manual {kind}: {content}", session_id, False)
        atom = self.spark.createDataFrame([(turn, "system", 1000, kind, content, 1.0, 1.0)], ATOMS)
        self._commit({"atoms": [self._write(atom, "atoms")]})
        hit = self.entries().filter((F.col("kind") == kind) & (F.col("content") == content) & (F.col("status") == "active")).orderBy(F.desc("entry_id")).first()
        return hit["entry_id"] if hit else -1

    def attach(self, path: str, source_turn_id: int | None = None) -> int:
        """Attaches files; returns the id of the first by name, be it new or known."""
        files = artifacts.read_files(self.spark, path)
        new = artifacts.attach(files, self.table("attachments"), source_turn_id)
        folder = self._write(new, "attachments")
        rows = self.spark.read.schema(ATTACHMENTS).parquet(f"{self.path}/{folder}")
        atoms = artifacts.artifact_atoms(rows).withColumn("authority", F.lit(0.95))
        self._commit({"attachments": [folder], "atoms": [self._write(_typed(atoms, ATOMS), "atoms")]})
        first = files.orderBy("filename").select("sha256").limit(1)
        return self.table("attachments").join(first, "sha256").first()["attachment_id"]

    def compact(self) -> None:
        """Rewrites each table into few files, turns in session order, and forgets the old versions' folders."""
        turns = self.table("turns").repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq")
        done = {"turns": turns, **{t: self.table(t) for t in ("atoms", "attachments", "sessions")}}
        self._commit({t: [self._write(df, t)] for t, df in done.items()}, replace=True)

    # ---- reading ----

    def entries(self) -> DataFrame:
        """The dictionary, folded from all atoms; the fold is stored and serves until atoms are added."""
        folders = self.manifest()["folders"] or {}
        key = "entries@" + hashlib.sha256("|".join(sorted(folders.get("atoms", []))).encode()).hexdigest()[:16]
        if key not in folders:
            self._commit({key: [self._write(_typed(self._folded(), ENTRIES), "entries")]})
            folders = self.manifest()["folders"]
        return self.spark.read.schema(ENTRIES).parquet(*[f"{self.path}/{f}" for f in folders[key]])

    def _folded(self) -> DataFrame:
        from .functions.constants import AUTHORITY
        from .functions.text import looked_up

        atoms = self.table("atoms")
        atoms = atoms.withColumn("authority", F.coalesce("authority", looked_up(F.col("role"), AUTHORITY, 0.55)))
        return dictionary.entries(dictionary.fold(atoms))[0]

    def search(self, queries: DataFrame, limit: int = 8, **kw: bool) -> DataFrame:
        return search(queries, self.table("turns"), self.entries().filter("status = 'active'"), self.table("attachments"), limit, **kw)

    def resume(self, task: str, budget: int = 1000, recent: int = 2) -> str:
        return resume(self.spark, task, self.table("turns"), self.entries(), self.table("attachments"), self.manifest()["title"], budget, recent)

    def _bytes(self, folders: list[str] | None = None) -> int:
        """Bytes of the files of some folders, or of all that the store has written."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
        paths = [self.path] if folders is None else [f"{self.path}/{f}" for f in folders]
        return (files.load(paths).agg(F.sum("length")).first()[0] or 0) if paths else 0

    def stats(self) -> dict:
        """Identity, counts, sizes and ratios (0.0 where there is nothing to divide by)."""
        m = self.manifest()
        out = ingest.stats(self.table("turns"), self.entries(), self.table("attachments")).first().asDict()
        folders, raw = m["folders"] or {}, out["raw_message_bytes"]
        files, stored = self._bytes(), self._bytes(folders.get("turns", []))
        return {
            "path": self.path,
            "title": m["title"],
            "codec": m["codec"],
            "format_version": m["version"],
            **out,
            "file_bytes": files,
            "block_payload_compressed_bytes": stored,
            "attachment_payload_compressed_bytes": self._bytes(folders.get("attachments", [])),
            "query_sketch_bytes": SKETCH_BYTES * out["index_records"],
            "payload_ratio": stored / raw if raw else 0.0,
            "file_to_raw_ratio": files / raw if raw else 0.0,
        }

    def get(self, ident: str) -> dict:
        """The turn, entry or attachment that T12, E3 or A1 names; turns and attachments must have the content of their hash."""
        kinds = {"T": ("turns", "turn_id"), "E": ("entries", "entry_id"), "A": ("attachments", "attachment_id")}
        name, key = kinds.get(ident[:1].upper(), (None, None))
        if name is None or not ident[1:].isdigit():
            raise ValueError("an id is T, E or A and a number")
        rows = (self.entries() if name == "entries" else self.table(name)).filter(F.col(key) == int(ident[1:]))
        hashed = {"turns": F.sha2("content", 256), "attachments": F.sha2("payload", 256)}.get(name)
        row = rows.withColumn("_now", hashed if hashed is not None else F.lit(None)).drop("payload").first()
        if row is None:
            raise KeyError(f"no {ident}")
        out = row.asDict()
        now = out.pop("_now")
        if now is not None and now != out["sha256"]:
            raise ValueError(f"{ident}: hash mismatch")
        return out

    def verify(self) -> list[str]:
        """Problems: folders of the manifest that can't be read, turns and attachments whose content and hash disagree."""
        lost = [f"{t} {f}: unreadable" for t, fs in (self.manifest()["folders"] or {}).items() for f in fs if not self._readable(f)]
        if lost:
            return lost
        bad = self.table("attachments").filter(F.sha2("payload", 256) != F.col("sha256")).select(F.concat(F.lit("attachment "), "attachment_id", F.lit(": hash mismatch")).alias("problem"))
        return [r["problem"] for r in ingest.verify(self.table("turns")).select("problem").unionByName(bad).collect()]

    def _readable(self, folder: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/{folder}").count()
            return True
        except Exception:
            return False

    def blocks(self) -> DataFrame:
        return ingest.blocks(self.table("turns"), self.manifest()["block_turns"])

    def export_jsonl(self, output: str) -> None:
        t = self.table("turns").orderBy("turn_id")
        t.select(F.to_json(F.struct("role", "content", "session_id", "created_at")).alias("value")).write.mode("overwrite").text(output)

    def export_markdown(self, output: str) -> None:
        t = self.table("turns").orderBy("turn_id")
        title = F.when(F.col("turn_id") == 1, f"# {self.manifest()['title']}\n\n").otherwise("")
        t.select(F.concat(title, markdown_turn(), F.lit("\n")).alias("value")).write.mode("overwrite").text(output)


def markdown_turn() -> Column:
    """A turn (turn_id, role, content) under its heading."""
    return F.concat(F.lit("## "), F.initcap("role"), F.lit(" · T"), "turn_id", F.lit("\n\n"), "content")


def _typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime())


def exists(path: str) -> bool:
    return os.path.isdir(f"{path}/manifest")
