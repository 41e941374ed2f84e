"""Secret scans through an incremental ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its text. The ledger holds one row for each
pair of blob and rule version that was ever scanned; a run scans only pairs that the ledger lacks,
appends them, and joins the findings back to all paths that carry the blob. Changing a rule changes
the rule version, so old findings stay valid for old rules.

Copies of one text, however many, leave each input partition once, as a compressed blob; the
findings meet the paths in a join on the digest that adaptive execution splits where it is skewed.
Appends go through Spark's committer, so a lost job adds nothing; pairs that two runs added twice
count once on reading. Runs that name the same ledger share it; ``session_ledger`` is the one of an
application, which its queries and its corpus pipeline use together.

Nulls count as empty texts, which have no findings; empty tables give empty results; repeated rows
each get their findings; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import lean, session_dir, slices, store_of, tidy


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


# The base patterns of the contract.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
# Public token formats. Runs have no upper bound; they are possessive and each starts behind
# a character that it cannot hold, so every character is read a bounded number of times.
MORE_RULES = (
    # up to the end line; without one, the marker with the long base64 lines behind it
    Rule("pem", r"-----BEGIN [A-Z ]*?PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*?PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("forge", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat", r"(?<![A-Za-z0-9])xox[abeprs]-[A-Za-z0-9-]{10,}+"),
    Rule("login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]++://[^\s:/@]++:[^\s:/@]++@"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:int,end:int>>"


def rule_version(rules: Sequence[Rule]) -> str:
    return hashlib.sha256(repr(tuple(rules)).encode()).hexdigest()[:16]


def compiled(rules: Sequence[Rule]) -> list[tuple[Rule, re.Pattern]]:
    """Patterns ready to run. Runs of one class that must be long are asked for at their least length:
    a run starts at the same place either way, and shorter ones would be dropped."""
    out = []
    for rule in rules:
        pattern = rule.pattern
        if rule in BASE_RULES[1:]:
            fixed = 4 if rule.kind == "access" else 0
            pattern = f"{pattern[:-1]}{{{rule.least - fixed},}}"
        # ASCII: without it, letters like the Kelvin sign would count as k
        out.append((rule, re.compile(pattern, re.ASCII | re.IGNORECASE if rule.any_case else 0)))
    return out


def find(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings by start, then by the rules' order; code points, end exclusive."""
    found = []
    for k, (rule, pattern) in enumerate(rules):
        for match in pattern.finditer(text):
            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                found.append((match.start(), k, match.end()))
    found.sort()
    return [(rules[k][0].kind, start, end) for start, k, end in found]


def _blobs(versions: DataFrame) -> DataFrame:
    """(digest, blob): each text of an input partition once, compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in slices(batches):
            kept: list[tuple[bytes, bytes]] = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    kept.append((digest, pack(text.encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in kept], pa.binary()), pa.array([b for _, b in kept], pa.binary())], names=["digest", "blob"])

    return versions.select("digest", "text").mapInArrow(lean(work), "digest binary, blob binary")


def _scanned(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(digest, spans) of blobs that are partitioned by digest; each digest once."""
    schema = pa.schema([("digest", pa.binary()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, ready, seen = zstandard.ZstdDecompressor().decompress, compiled(rules), set()
        for batch in slices(batches):
            digests, spans = [], []
            for digest, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in find(unpack(blob).decode("utf-8", "surrogatepass"), ready)])
            yield pa.RecordBatch.from_arrays([pa.array(digests, schema.types[0]), pa.array(spans, schema.types[1])], schema=schema)

    return blobs.mapInArrow(lean(work), f"digest binary, spans {SPANS}")


def _exists(spark, path: str) -> bool:
    store, target = store_of(spark, path)
    return store.exists(target)


def session_ledger(spark) -> str:
    """The ledger of this application."""
    return f"{session_dir(spark)}/secret-ledger"


def read_ledger(spark, ledger: str) -> DataFrame:
    """All rows of a ledger: digest, rule_version, spans."""
    return spark.read.schema(f"digest binary, rule_version string, spans {SPANS}").parquet(ledger)


def scan(docs: DataFrame, ledger: str, *, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what ``ledger`` lacks, append it there, and return ``id_cols``, ``digest`` and ``spans`` of every row."""
    spark = docs.sparkSession
    version = rule_version(rules)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    versions = docs.select(*id_cols, F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    blobs = _blobs(versions)
    if _exists(spark, ledger):
        blobs = blobs.join(read_ledger(spark, ledger).where(F.col("rule_version") == version).select("digest"), "digest", "left_anti")
    fresh = _scanned(blobs.repartition("digest"), rules)
    with tidy(spark):
        fresh.select("digest", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(ledger)
    findings = read_ledger(spark, ledger).where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("digest", "spans").dropDuplicates(["digest"])
    found = versions.drop("text").join(findings, "digest", "left")
    return found.select(*id_cols, F.lower(F.hex("digest")).alias("digest"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: Sequence[tuple[str, int, int]], mark: str = "[{kind}]") -> str:
    """``text`` with each run of overlapping spans replaced by the mark of its first kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])
