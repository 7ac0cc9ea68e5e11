"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger is a table of (blob, rule_version, spans);
a scan reads only blobs that have no entry for its rule version, each once however many versions share it, and findings
are joined back to all of them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, materialize

RULE_VERSION = 1
#: The three base kinds come first; the rest are added by this scanner.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "github", "jwt")

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_RULES = {
    # a maximal run that is too short holds no shorter one that is long enough, so the length may stand in the pattern
    "access": ("AKIA", re.compile(r"AKIA[A-Z0-9]{12,}")),
    "hex": ("", re.compile(r"[0-9a-f]{32,}")),
    "pem": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    "github": ("gh", re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}")),
}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of KINDS."""
    out = []
    low = text.lower()  # may be longer than the text; only asked whether a keyword can occur
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for kind, (mark, rule) in _RULES.items():
        if mark in text:
            out += [(kind, m.start(), m.end()) for m in rule.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _blob() -> Column:
    """A version's address: the SHA-256 of its text, a null text being empty."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def pending_texts(docs: DataFrame, pending: DataFrame) -> DataFrame:
    """(blob, text): the texts of the pending blobs (blob, holder), one row for each row of their holders that is that blob.

    Both sides carry the address, so a path of v versions gives v rows, and a null id is a path like any other."""
    versions = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("holder"), _blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    return versions.join(pending, ["holder", "blob"]).select("blob", "text")


def scan_pending(docs: DataFrame, pending: DataFrame, rule_version: int) -> DataFrame:
    """Ledger rows of the pending blobs (blob, holder)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blob, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = spans_of(text)
                base = [s for s in spans if s[0] in BASE_KINDS]
                rows.append((blob, *(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans)))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = pending_texts(docs, pending).mapInArrow(run, "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.dropDuplicates(["blob"]).withColumn("rule_version", F.lit(rule_version))


def scan(docs: DataFrame, ledger: str | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs`` (doc_id, text).

    ``ledger`` is the ledger's folder (a new one in the shared folder if None); what it knows under ``rule_version`` is
    not scanned again, and what is new is appended. A null text is empty and holds nothing. Rows that share a doc_id are
    versions of their own; a null doc_id stays null. An empty table gives no rows. Other columns are not read."""
    spark = docs.sparkSession
    at = ledger or fresh_path(spark, "secret_ledger")
    versions = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _blob().alias("blob")))
    # a row with an id is preferred: the rows without one all share a key
    pending = versions.groupBy("blob").agg(F.coalesce(F.min("doc_id"), F.lit(-1)).alias("holder"))
    kind = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, rule_version int"
    spark.createDataFrame([], kind).write.mode("append").parquet(at)
    known = spark.read.schema(kind).parquet(at).filter(F.col("rule_version") == rule_version)
    pending = materialize(pending.join(known.select("blob"), "blob", "left_anti"))
    scan_pending(docs, pending, rule_version).write.mode("append").parquet(at)
    found = spark.read.schema(kind).parquet(at).filter((F.col("rule_version") == rule_version) & (F.col("spans") != ""))
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_assign", "n_access", "n_hex")]
    return versions.join(found.drop("rule_version"), "blob", "left").select(
        "doc_id", *zero, F.coalesce("base_sha256", F.lit(EMPTY_SHA256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )
