"""Secret scans with a ledger of content-addressed blobs.

A text is a blob, named by the SHA-256 of its bytes; the row it stands in is a
path. Only blobs that the ledger has not seen under a rule version are scanned,
each once however many paths have it, and findings are joined back to all paths.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the kinds of the base rules, in order of rank
BASE = ("assign", "access", "hex")
EXTRA = ("pem", "jwt", "github", "slack")

#: (kind, pattern, group whose length counts, least length); later rules change the version
RULES = (
    (
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),  # a whole run, as shorter runs fail
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)
VERSION = 1
#: a text without these letters (in either case, for "assign") has no match of the kind
HINTS = {"access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ", "slack": "xox"}

FINDINGS = "blob binary, version int, spans array<struct<kind:string,start:long,end:long>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanner(rules, version):
    compiled = [
        (kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), group, least)
        for kind, pattern, group, least in rules
    ]

    def spans(text):
        found = []
        for rank, (kind, pattern, group, least) in enumerate(compiled):
            if HINTS.get(kind, "") not in text:
                continue
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), rank, kind, m.end()))
        found.sort()
        return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in found]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [spans(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([version] * len(found), pa.int32()), pa.array(found, SPANS)],
                    names=["blob", "version", "spans"],
                )

    return run


def blob_name(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


def scan(blobs: DataFrame, ledger: DataFrame | None = None, rules=RULES, version: int = VERSION) -> DataFrame:
    """(blob, version, spans) of the blobs (blob, text) that ``ledger`` (blob, version, ...) lacks.

    Append the result to the ledger to make the next scan incremental.
    """
    if ledger is not None:
        seen = ledger.where(F.col("version") == version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return once.select("blob", "text").mapInArrow(_scanner(rules, version), FINDINGS)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ledger: DataFrame | None = None,
    rules=RULES,
    version: int = VERSION,
) -> DataFrame:
    """(id, spans) for every row of ``docs``: what its text holds, by start, then rank of the rule.

    Spans are in code points, end exclusive. A null text counts as empty; rows
    may repeat and ids may be null, every row gets its own result. Findings the
    ledger already has are used as they are. Other columns are ignored; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("blob", blob_name(F.col("text")))
    found = scan(named.select("blob", "text"), ledger, rules, version)
    if ledger is not None:
        found = found.unionByName(ledger.where(F.col("version") == version).select("blob", "version", "spans"))
    hits = found.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    out = named.select("id", "blob").join(hits, "blob", "left")
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))
