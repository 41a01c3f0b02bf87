"""Secret scans by an incremental blob ledger.

Each version of a text is a blob, addressed by its SHA-256. The ledger is a stored table with a row for every (blob,
rule version) that was scanned, findings or none. A scan reads only blobs without a row for the present rule version,
appends their rows and joins the findings back to every path, and every version of it, that holds the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: The base rules in their order; a match is kept if its test holds, failing ones aren't retried.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so as those of + that have 16 characters
_HINTS = (b"passw", b"secret", b"token", b"api")
BASE = ("assign", "access", "hex")
#: Further rules: text that must be there, pattern.
MORE = {
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b")),
    "pem": ("PRIVATE KEY", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
}
RULE_VERSION = hashlib.sha256(
    repr([x.pattern for x in (_ASSIGN, _ACCESS, _HEX)] + [(k, h, p.pattern) for k, (h, p) in MORE.items()]).encode()
).hexdigest()[:16]
_SCANNED = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
LEDGER = _SCANNED + ", rule_version string"


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the order of the rules."""
    if not text:
        return []
    found = []
    low = text.encode().lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, (hint, pattern) in enumerate(MORE.values(), len(BASE)):
        if hint in text:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    kinds = (*BASE, *MORE)
    return [(kinds[k], s, e) for s, k, e in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = find_secrets(text.as_py())
            kinds = [k for k, _, _ in spans]
            base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE)
            rows.append((*map(kinds.count, BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))]
        yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _SCANNED.split(", ")])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path, each (blob, rule_version) once, even if two scans appended it at a time; empty if there is none yet."""
    try:
        found = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
    return found.dropDuplicates(["blob", "rule_version"])


def scan_unseen(history: DataFrame, ledger: str, key: list[str], text: str = "text") -> DataFrame:
    """Scan what the ledger at that path lacks and append it; returns the key columns and blob of each row of history.

    key names a path, or a path and its version. A row appears in the ledger only when its scan has been committed,
    so a scan that failed or is repeated leaves nothing twice. A null text is the empty blob; keys may be null or
    repeat, their rows come back as often.
    """
    scratch = Scratch(history.sparkSession)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    place = F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)))
    own = history.select(place.alias("place"), F.sha2(content, 256).alias("blob"), content.alias("content"))
    paths = scratch.keep(own.select("place", "blob"))
    seen = read_ledger(history.sparkSession, ledger).where(F.col("rule_version") == RULE_VERSION)
    unseen = paths.groupBy("blob").agg(F.min("place").alias("at")).join(seen, "blob", "left_anti")  # any place serves to read a blob
    unseen = unseen.withColumnRenamed("blob", "b").hint("shuffle_hash")
    read = own.join(unseen, F.col("place").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("b")))
    new = read.select("blob", "content").mapInArrow(_scan, _SCANNED).dropDuplicates(["blob"])  # a place may be there twice with the same blob
    new.withColumn("rule_version", F.lit(RULE_VERSION)).write.mode("append").parquet(ledger)
    return paths.select(*(F.col("place")[f"k{i}"].alias(k) for i, k in enumerate(key)), "blob")


def secret_findings(docs: DataFrame, ledger: str | None = None, key: list[str] | None = None) -> DataFrame:
    """The key columns (doc_id), n_assign, n_access, n_hex, base_sha256, spans of each row of docs, through the ledger.

    ledger is its folder, shared and kept between scans; a new one that ends with the session if it is None. Null,
    empty and very long texts are scanned whole as any other; an empty table gives no rows; only the key columns and
    text are read.
    """
    ledger = ledger or f"{Scratch(docs.sparkSession).folder}/ledger"
    key = key or ["doc_id"]
    paths = scan_unseen(docs, ledger, key)
    known = read_ledger(docs.sparkSession, ledger).where(F.col("rule_version") == RULE_VERSION)
    return paths.join(known, "blob").select(*key, "n_assign", "n_access", "n_hex", "base_sha256", "spans")
