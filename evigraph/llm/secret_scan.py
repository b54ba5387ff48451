"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its UTF-8 bytes).
Equal contents are one blob, whatever their paths and versions.  The ledger
holds the (blob, rule, rule version) triples that have been scanned; a scan
touches only blobs with an unseen triple, and only with the rules they lack.
Findings are stored per (blob, rule, rule version), appended with the ledger after
each scan (findings first, so that a scan that is lost between the two is done again), and joined back to every
path that ever held the blob, at the current rule versions.  ``Store`` keeps both tables in a folder.

Edge cases: a null text counts as empty; an empty text has no findings; repeated
rows share one blob and each keeps its row in the result.  Columns other than
the path columns and the text are ignored.  An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, documents, values, whole_text

#: Fixed patterns of the base kinds, in their listed order, then the kinds added here.
#: kind, rule version, pattern, group measured, least length of that group
RULES = [
    ("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    ("pem", 1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 0),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("hosting", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 0),
    ("urlauth", 1, r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._%-]{1,64}:[^\s:@/]{6,128}@", 0, 0),
]
BASE = ("assign", "access", "hex")

#: A text without any of these (lower-cased) can't match the rule; str.find is far cheaper than a failing regular expression.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "pem": ("private key",), "jwt": ("eyj",), "hosting": ("gho_", "ghp_", "ghs_", "ghu_", "ghr_"), "urlauth": ("://",)}

FINDING = "array<struct<kind:string,version:int,start:long,end:long>>"


def rule_id(kind: str, version: int) -> str:
    return f"{kind}@{version}"


def find(text: str, rules=RULES) -> list[tuple[str, int, int, int]]:
    """(kind, version, start, end) in code points, by start and then the order of the rules."""
    lower, found = text.lower(), []
    for order, (kind, version, pattern, group, least) in enumerate(rules):
        if kind in HINTS and not any(h in lower for h in HINTS[kind]):
            continue
        for m in _compiled(pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, version, m.end()))
    return [(kind, version, start, end) for start, _, kind, version, end in sorted(found)]


def _compiled(pattern: str):
    return re.compile(pattern, re.ASCII)


def blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """(blob, text): one row per distinct content; copies meet in the map-side part of the aggregation."""
    content = whole_text(text)
    return versions.select(F.sha2(content, 256).alias("blob"), content.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=None, text: str = "text") -> DataFrame:
    """Scan unseen (blob, rule version) pairs.

    Returns (blob, scanned array<string> of rule ids, findings) for each blob that
    had an unseen pair.  ``ledger`` has the columns (blob, rule) of earlier scans.
    """
    rules = list(rules or RULES)
    ids = [rule_id(r[0], r[1]) for r in rules]
    every = F.array(*map(F.lit, ids))
    if ledger is None:
        todo = blobs(versions, text).select("blob", "text", every.alias("todo"))
    else:  # only addresses meet the ledger; texts of blobs that have been seen by all rules aren't shuffled where the unseen ones are few
        seen = ledger.where(F.col("rule").isin(ids)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most one entry a rule
        unseen = versions.select(F.sha2(whole_text(text), 256).alias("blob")).distinct().join(seen, "blob", "left")
        unseen = unseen.select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        content = versions.select(F.sha2(whole_text(text), 256).alias("blob"), whole_text(text).alias("text")).join(unseen, "blob")
        todo = content.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))

    def run(batches):
        by_id = dict(zip(ids, rules, strict=True))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for content, names in zip(values(batch.column(1)), values(batch.column(2)), strict=True):
                wanted = set(names)
                hits = find(content, [r for i, r in by_id.items() if i in wanted])
                out.append([dict(zip(("kind", "version", "start", "end"), h, strict=True)) for h in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, kind)], names=["blob", "scanned", "findings"])

    return todo.mapInArrow(run, f"blob string, scanned array<string>, findings {FINDING}")


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """(blob, rule) rows to append to the ledger after a scan."""
    return scanned.select("blob", F.explode("scanned").alias("rule"))


def finding_rows(scanned: DataFrame) -> DataFrame:
    """(blob, rule, findings) rows to append to the findings table after a scan, one for each rule that found something."""
    rule = F.explode(F.array_distinct(F.transform("findings", lambda x: F.concat_ws("@", x["kind"], x["version"].cast("string")))))
    rows = scanned.select("blob", "findings", rule.alias("rule"))
    return rows.select("blob", "rule", F.filter("findings", lambda x: F.concat_ws("@", x["kind"], x["version"].cast("string")) == F.col("rule")).alias("findings"))


def current_findings(stored: DataFrame, rules=None) -> DataFrame:
    """(blob, findings) of the findings table: one row a blob, at the given rule versions, in the order of a single scan.

    A (blob, rule) pair that was appended twice counts once.
    """
    rules = list(rules or RULES)
    place = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r[0], k)))
    now = stored.where(F.col("rule").isin([rule_id(r[0], r[1]) for r in rules])).groupBy("blob", "rule").agg(F.first("findings").alias("findings"))
    keyed = lambda x: F.struct(x["start"].alias("start"), place[x["kind"]].alias("place"), x["end"].alias("end"), x.alias("finding"))
    merged = F.array_sort(F.transform(F.flatten(F.collect_list("findings")), keyed))
    return now.groupBy("blob").agg(F.transform(merged, lambda x: x["finding"]).alias("findings"))


def findings_by_path(versions: DataFrame, scanned: DataFrame, paths: list[str], text: str = "text", rules=None) -> DataFrame:
    """The path columns, blob and findings of every row; rows without a finding have an empty array.

    ``scanned`` is the findings table of all scans (see finding_rows), read at the
    versions of ``rules``, or a single full scan.  Only blobs with findings take part in
    the join; a hot blob meets one row there, which the skew join splits over tasks.
    """
    hits = current_findings(scanned, rules) if "rule" in scanned.columns else scanned.where(F.size("findings") > 0).select("blob", "findings")
    rows = versions.select(*paths, F.sha2(whole_text(text), 256).alias("blob"))
    return rows.join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDING)))


class Store:
    """Ledger and findings of all scans, as Parquet tables in a folder that all executors share."""

    def __init__(self, spark, folder: str):
        self.spark, self.ledger, self.findings = spark, f"{folder}/ledger", f"{folder}/findings"

    def _read(self, path: str, schema: str) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(path) if found else None

    def seen(self) -> DataFrame | None:
        """(blob, rule) of all scans; None before the first."""
        return self._read(self.ledger, "blob string, rule string")

    def stored(self) -> DataFrame:
        """(blob, rule, findings) of all scans."""
        schema = f"blob string, rule string, findings {FINDING}"
        found = self._read(self.findings, schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def update(self, versions: DataFrame, rules=None, text: str = "text") -> None:
        """Scan what has not been seen, and append to both tables."""
        scanned = Scratch(self.spark, "scan").table(scan(versions, self.seen(), rules, text), "scanned")  # read twice
        finding_rows(scanned).write.mode("append").parquet(self.findings)
        ledger_rows(scanned).write.mode("append").parquet(self.ledger)


def op1_secret_scans(spark, sf_dir) -> DataFrame:
    """Scans the table into a new store and reads the findings back from it."""
    docs = documents(spark, sf_dir)
    store = Store(spark, Scratch(spark, "secrets").root)
    store.update(docs)
    rows = findings_by_path(docs, store.stored(), ["doc_id"])
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("findings", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
    )


def base_by_hand(text: str | None) -> tuple[int, int, int, str]:
    """The contract's base columns by its own patterns, for tests."""
    text = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(RULES[0][2], text, re.ASCII) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    n = [sum(1 for x in found if x[1] == k) for k in range(3)]
    return *n, hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
