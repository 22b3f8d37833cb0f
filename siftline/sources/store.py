"""The store: saved audits as Parquet tables that change together.

A save writes all tables of a run into folders of a new version, and then one small file, the run's
manifest, which names that version. The file appears under its own name by a rename that fails if
the name is taken, so a save is seen whole or not at all, a reader follows one version of a run
through all tables, and the later of two saves of a run takes the place of the other. Versions that
no manifest names any more are left for readers that still follow them; vacuum() deletes them.

    <root>/manifests/<run tag>/<number>.json
    <root>/<table>/run=<run tag>/version=<v>/day=<of expiry>/shard=<s>/...

An audit's id begins with its run's tag and goes on with a digest of its page, whose first digits are
its shard: a lookup by id reads one manifest and one shard folder of a table, sorted by id. Rows
expire: reads hide what has, purge() deletes it by whole days.

Beside the audits a save keeps what questions over many audits need: partial aggregates with
sketches of distinct counts (see operators.rollups), merged when read, and the search index (see
operators.search). Both expire with their audits.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import rollups, search
from ..operators.audit import Audit, metadata
from .scratch import Scratch

RETENTION_DAYS = 30
TABLES = ("audits", "audit_checks", "audit_category_scores", "audit_metadata")
AUDITS = "audit_id string, page_id long, url string, state string, error_code string, error_message string, total int, band string, created_at timestamp, expires_at timestamp"
DERIVED = ("audit_totals", "audit_texts", "audit_postings")
# Longest texts that are kept.
LIMITS = {"value": 500, "message": 2000, "recommendation": 2000, "title": 500, "meta_description": 1000, "canonical": 1000, "html_lang": 35, "error_message": 1000}
#: Hex digits of an audit_id that name its run, and of the rest, its page.
RUN_DIGITS, PAGE_DIGITS = 12, 20


def cut(name: str) -> Column:
    return F.substring(F.col(name), 1, LIMITS[name]).alias(name)


def run_tag(run: str) -> str:
    return hashlib.sha256(run.encode()).hexdigest()[:RUN_DIGITS]


def audit_id(run: str) -> Column:
    """The run's tag, then a digest of run and page (null pages: of the empty string)."""
    page = F.sha2(F.concat_ws("|", F.lit(run), F.col("page_id").cast("string")), 256)
    return F.concat(F.lit(run_tag(run)), F.substring(page, 1, PAGE_DIGITS))


def frames(a: Audit, run: str, now: Column, days: int = RETENTION_DAYS) -> dict[str, DataFrame]:
    """The four tables of completed audits."""
    key = audit_id(run).alias("audit_id")
    ends = (now + F.make_dt_interval(F.lit(days))).alias("expires_at")
    return {
        "audits": a.scores.select(key, "page_id", "url", F.lit("COMPLETED").alias("state"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), "total", "band", now.alias("created_at"), ends),
        "audit_checks": a.results.select(key, "check_key", "title", "category", "status", "severity", cut("value"), cut("message"), cut("recommendation"), "confidence", "details", ends).withColumn("text_id", search.text_id()),
        "audit_category_scores": a.categories.select(key, "category", "score", "max_score", "ratio", "checks_total", "checks_passed", ends),
        "audit_metadata": metadata(a).select(key, *[cut(c) for c in ("title", "meta_description", "canonical", "html_lang")], "word_count", "h1_count", "internal_links", "external_links", "images", "images_missing_alt", "schema_types", "is_noindex", ends),
    }


def failed(rows: DataFrame, run: str, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """(page_id, url, error_code, error_message) to rows of audits."""
    return rows.select(audit_id(run).alias("audit_id"), "page_id", "url", F.lit("FAILED").alias("state"), "error_code", cut("error_message"), F.lit(None).cast("int").alias("total"), F.lit(None).cast("string").alias("band"), now.alias("created_at"), (now + F.make_dt_interval(F.lit(days))).alias("expires_at"))


def alive(now: Column) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") >= now)


def purged(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter(alive(now))


class Store:
    """digits: hex digits of the page's digest that name a shard; more for runs of billions of pages."""

    def __init__(self, spark: SparkSession, root: str, digits: int = 1):
        self.spark, self.root, self.digits = spark, root.rstrip("/"), digits

    # Files

    def _fs(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, path: str):
        p = self._fs().Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return p, p.getFileSystem(conf)

    def _glob(self, pattern: str) -> list:
        p, system = self._path(pattern)
        return [x for x in (system.globStatus(p) or [])]

    # Versions

    def _manifests(self, tag: str = "*") -> dict[str, dict]:
        """The latest manifest of each run; the driver reads one line for each."""
        latest: dict[str, tuple[str, object]] = {}
        for x in self._glob(f"{self.root}/manifests/{tag}/*.json"):
            run, number = x.getPath().getParent().getName(), x.getPath().getName()
            if number > latest.get(run, ("",))[0]:
                latest[run] = number, x.getPath()
        out = {}
        for run, (number, path) in latest.items():
            stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(path)
            try:
                out[run] = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": int(number.partition(".")[0])}
            finally:
                stream.close()
        return out

    def _commit(self, tag: str, manifest: dict) -> None:
        """Put the manifest in place under the next free number."""
        text = json.dumps(manifest)
        draft, system = self._path(f"{self.root}/manifests/{tag}/.{uuid.uuid4().hex}.draft")
        stream = system.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._fs().FileContext.getFileContext(system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._fs(), "Options$Rename"), 0)
        while True:
            number = self._manifests(tag).get(tag, {"number": 0})["number"] + 1
            try:
                context.rename(system.makeQualified(draft), system.makeQualified(self._path(f"{self.root}/manifests/{tag}/{number:012d}.json")[0]), plain)
                return
            except Exception as e:  # another save of this run was faster: take the next number
                if "FileAlreadyExists" not in str(e):
                    raise

    def _write(self, name: str, df: DataFrame, tag: str, version: str, key: str) -> str:
        """One table of a version, dealt to shards by key's first digits and sorted by key; its schema."""
        shard = F.substring(F.col(key), RUN_DIGITS + 1 if key == "audit_id" else 1, self.digits)
        rows = df.withColumn("day", F.to_date("expires_at")).withColumn("shard", shard)
        rows = rows.repartition("day", "shard").sortWithinPartitions("day", "shard", key)
        rows.write.partitionBy("day", "shard").parquet(f"{self.root}/{name}/run={tag}/version={version}")
        return df.schema.json()

    def save(self, tables: dict[str, DataFrame], run: str) -> None:
        """Write a run's tables, with aggregates and search index, and make them the run's at once."""
        tag, version = run_tag(run), uuid.uuid4().hex
        told = {"run": run, "version": version, "tables": {}}
        for name, df in tables.items():
            told["tables"][name] = self._write(name, df, tag, version, "audit_id")
        own = {name: self._read(name, {tag: told}) for name in tables}
        if "audits" in own:
            told["tables"]["audit_totals"] = self._write("audit_totals", rollups.partials(own["audits"], own.get("audit_checks")), tag, version, "digest")
        if "audit_checks" in own:
            texts = search.texts(own["audit_checks"])
            told["tables"]["audit_texts"] = self._write("audit_texts", texts, tag, version, "text_id")
            texts = self._read("audit_texts", {tag: told})
            told["tables"]["audit_postings"] = self._write("audit_postings", search.postings(texts), tag, version, "digest")
        self._commit(tag, told)

    def save_audit(self, a: Audit, run: str, now: Column, days: int = RETENTION_DAYS) -> None:
        """save() of an audit, whose pages are read and parsed once for all tables."""
        kept = Audit(Scratch(self.spark, "audit").keep(a.wide))
        self.save(frames(kept, run, now, days), run)

    def vacuum(self, older_ms: int = 24 * 3600 * 1000) -> int:
        """Delete versions that no manifest names and that were written so long ago; their number."""
        named, gone = {(tag, m["version"]) for tag, m in self._manifests().items()}, 0
        now = self.spark.sparkContext._jvm.System.currentTimeMillis()
        for x in self._glob(f"{self.root}/*/run=*/version=*"):
            p = x.getPath()
            if (p.getParent().getName()[4:], p.getName()[8:]) not in named and now - x.getModificationTime() >= older_ms:
                self._path(p.toString())[1].delete(p, True)
                gone += 1
        return gone

    # Reads

    def _read(self, name: str, manifests: dict[str, dict]) -> DataFrame:
        """A table over the versions that these manifests name."""
        there = {tag: m for tag, m in manifests.items() if name in m["tables"]}
        if not there:
            raise LookupError(f"no run has saved {name}")
        schema = StructType.fromJson(json.loads(next(iter(there.values()))["tables"][name]))
        for c, kind in (("run", "string"), ("version", "string"), ("day", "date"), ("shard", "string")):
            schema = schema.add(c, kind)
        paths = [f"{self.root}/{name}/run={tag}/version={m['version']}" for tag, m in there.items()]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).drop("run", "version", "day")

    def table(self, name: str, now: Column | None = None) -> DataFrame:
        """All runs' rows that have not expired."""
        return self._read(name, self._manifests()).drop("shard").filter(alive(now if now is not None else F.current_timestamp()))

    def _of(self, manifests: dict[str, dict], name: str, key: str, now: Column | None) -> DataFrame:
        rows = self._read(name, manifests).filter((F.col("shard") == key[RUN_DIGITS : RUN_DIGITS + self.digits]) & (F.col("audit_id") == key))
        return rows.drop("shard").filter(alive(now if now is not None else F.current_timestamp()))

    def _run_of(self, key: str) -> dict[str, dict]:
        return self._manifests(key[:RUN_DIGITS]) if key[:RUN_DIGITS].isalnum() else {}

    def get(self, key: str, now: Column | None = None) -> DataFrame:
        """Point lookup in one shard of one run; no rows for an unknown key, or once it has expired."""
        manifests = self._run_of(key)
        return self._of(manifests, "audits", key, now) if manifests else self.spark.createDataFrame([], AUDITS)

    def report(self, key: str, now: Column | None = None) -> DataFrame:
        """The audit with its checks, category scores and metadata, as one row of one version; of a
        failed or unknown one only its own columns."""
        manifests = self._run_of(key)
        if not manifests:
            return self.get(key, now)
        out = self._of(manifests, "audits", key, now)
        for name in TABLES[1:]:
            if name not in manifests[key[:RUN_DIGITS]]["tables"]:  # a run of failed audits
                continue
            rows = self._of(manifests, name, key, now).drop("expires_at")
            if name != "audit_metadata":
                rows = rows.groupBy("audit_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "audit_id"])).alias(name))
            out = out.join(rows, "audit_id", "left")
        return out

    def search(self, needle: str, now: Column | None = None) -> DataFrame:
        """Checks of all saved audits that contain the needle, found by the index."""
        return search.found(self.table("audit_checks", now), self.table("audit_texts", now), self.table("audit_postings", now), needle)

    # Ends

    def purge(self, now: Column) -> int:
        """Drop the days that are over; the number of audits that went. What expires later today is
        hidden by reads and goes tomorrow."""
        today = self.spark.range(1).select(F.to_date(now).alias("d")).first().d
        manifests, gone = self._manifests(), 0
        audits = {tag: m for tag, m in manifests.items() if "audits" in m["tables"]}
        if audits:
            gone = self._read("audits", audits).filter(F.to_date("expires_at") < F.lit(today)).count()
        for x in self._glob(f"{self.root}/*/run=*/version=*/day=*"):
            if x.getPath().getName()[4:] < today.isoformat():
                self._path(x.getPath().toString())[1].delete(x.getPath(), True)
        return gone
