"""Secret scans over an incremental ledger of text versions.

Every text version is a blob named by the SHA-256 of its bytes.  The ledger, a Parquet table in a shared folder, has a
row per scanned blob: the rules (name and version) that it was scanned with, and the findings.  A scan looks only at
blobs and rule versions that the ledger has not seen, once per blob however many rows hold it, appends what it found,
and joins the findings back to every row.  Raising a rule's version makes its pairs unseen again; stopping in the
middle loses at most the unfinished append.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import whole, written


def _either(word: str) -> str:
    """Letters as classes of two, so that no other letter counts as one in the other case."""
    return "".join(f"[{c.upper()}{c}]" for c in word)


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; a match whose ``group`` is shorter than ``least`` is dropped.

    ``hints``: one of these occurs in the lower-cased text wherever there is a match; none means always look.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    #: The group that is the finding.
    span: int = 0

    @property
    def label(self) -> str:
        return f"{self.name}@{self.version}"


_KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either('api')}_?{_either('key')}"

#: In the order in which kinds that start together are listed.
RULES = (
    Rule("assign", 1, rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    # Runs of 24 and more are the whole runs that pass, as runs do not overlap.
    Rule("hex", 1, "[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0,
         ("private key-----",)),
    # Of a run only its first place is tried: what comes before the token is passed once, and never given back.
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
         0, 0, ("eyj",), 1),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, ("xox",)),
    Rule("url", 2, r"(?<![A-Za-z0-9+.-])[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@]++:([^\s/@]++)@)", 2, 4, ("://",), 1),
)
BASE = ("assign", "access", "hex")
FINDING = "array<struct<kind:string,start:int,end:int>>"


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, rule by rule."""
    low = text.lower()
    return [
        (rule.name, m.start(rule.span), m.end(rule.span))
        for rule in rules
        if not rule.hints or any(h in low for h in rule.hints)
        for m in re.finditer(rule.pattern, text)
        if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]


def read_ledger(docs: DataFrame, ledger: str) -> DataFrame:
    """blob, rules, findings; empty if nothing was ever scanned."""
    spark = docs.sparkSession
    schema = f"blob string, rules array<string>, findings {FINDING}"
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_unseen(docs: DataFrame, blobs: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> None:
    """Scan the pairs of blob and rule version that the ledger lacks, and append them to it."""
    labels = F.array(*[F.lit(r.label) for r in rules])
    seen = read_ledger(docs, ledger).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("_seen"))
    holders = blobs.groupBy("blob").agg(F.min("doc_id").alias("_holder"))
    need = holders.join(seen, "blob", "left").select(
        "blob", "_holder", F.array_except(labels, F.coalesce("_seen", F.array().cast("array<string>"))).alias("_rules")
    )
    need = need.filter(F.size("_rules") > 0)
    rows = docs.select(F.col("doc_id").alias("_id"), whole().alias("_text"))
    work = rows.join(need, F.col("_id").eqNullSafe(F.col("_holder"))).filter(F.sha2("_text", 256) == F.col("blob"))
    by_label = {r.label: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            wanted = batch.column("_rules").to_pylist()
            found = [
                [dict(kind=k, start=s, end=e) for k, s, e in find(text, tuple(by_label[x] for x in own))]
                for text, own in zip(batch.column("_text").to_pylist(), wanted)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array(wanted, pa.list_(pa.string())), pa.array(found, kind)], ["blob", "rules", "findings"]
            )

    scanned = work.select("blob", "_rules", "_text").mapInArrow(run, f"blob string, rules array<string>, findings {FINDING}")
    scanned.write.mode("append").parquet(ledger)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, findings (by start, then in the order of the rules) of every row of ``docs``.

    A null text is the empty blob; very long texts are searched whole, in time linear in their length.  Rows with equal texts share one scan; rows that repeat an id are fine, each text
    has its own blob.  Findings of rules or versions that are not asked for are left out.
    """
    blobs = written(docs.select("doc_id", F.sha2(whole(), 256).alias("blob")), "blobs")
    scan_unseen(docs, blobs, ledger, rules)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    current = {r.label for r in rules}
    rows = read_ledger(docs, ledger)
    # A row's findings count only for those of its rules whose version is the one asked for.
    names = F.transform(F.filter("rules", lambda r: r.isin(*current)), lambda r: F.substring_index(r, "@", 1))
    own = rows.filter(F.size("findings") > 0).select("blob", names.alias("_names"), "findings")
    own = own.select("blob", F.filter("findings", lambda f: F.array_contains("_names", f["kind"])).alias("findings"))
    ordered = F.array_sort(
        F.array_distinct(F.flatten(F.collect_list("findings"))),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(order[a["kind"]] - order[b["kind"]]),
    )
    found = own.groupBy("blob").agg(ordered.alias("findings"))
    return blobs.join(found, "blob", "left").select(
        "doc_id", "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings")
    )
