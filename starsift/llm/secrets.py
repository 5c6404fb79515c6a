"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a Parquet
table with one row for each (blob, rule version) that was scanned. A scan finds the distinct blobs
of its input that the ledger lacks under the present rule version, scans one copy of each, adds
them to the ledger, and joins the findings back to all paths by blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starsift.storage import new_path

#: The base rules, in the order in which their kinds are listed: pattern, group that counts, least length.
BASE_RULES = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Rules that the operator adds: private keys, web tokens, and tokens of known issuers.
MORE_RULES = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "issued": (r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 1),
}
KINDS = [*BASE_RULES, *MORE_RULES]
RULE_VERSION = hashlib.sha256(repr((BASE_RULES, MORE_RULES)).encode()).hexdigest()[:16]

_COMPILED = {kind: (re.compile(pattern), group, least) for kind, (pattern, group, least) in (BASE_RULES | MORE_RULES).items()}
#: A text without any of these, in lower case, has no match of the rule, so the rule isn't tried.
_NEEDS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "pem": ("private key-----",), "jwt": ("eyj",), "issued": ("gh", "xox", "sk_live_")}
_RUN = re.compile(r"[0-9a-f]{32,}")  # the same spans as the base rule's, without its short matches


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of ``text`` in code points, by start, then by kind as listed.

    Matches are leftmost and don't overlap within a kind; a match that is too short is dropped, and
    what it covers isn't searched again.
    """
    found = []
    low = text.lower()
    for kind, (pattern, group, least) in _COMPILED.items():
        if kind == "hex":
            found += [(m.start(), m.end(), kind) for m in _RUN.finditer(text)]
        elif any(x in low for x in _NEEDS[kind]):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span replaced by its kind in square brackets; spans that overlap count as one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for blob, text in zip(batch["blob"], batch["text"], strict=True):
            spans = find(text)
            base = [s for s in spans if s[2] in BASE_RULES]
            rows.append((blob, *(sum(s[2] == kind for s in base) for kind in BASE_RULES), _joined(base), _joined(spans)))
        yield pd.DataFrame(rows, columns=["blob", "n_assign", "n_access", "n_hex", "base", "spans"])


_FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base string, spans string"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or None where nothing was scanned yet."""
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def with_blob(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the content address of each row as ``blob``; null counts as empty."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger lacks, and return (blob, n_assign, n_access, n_hex, base, spans) of all blobs known.

    ``docs`` has a row for each version of each path; equal contents are scanned once. Null texts
    are empty blobs; a repeated row, a repeated or null id and further columns change nothing; an
    empty table adds nothing.
    """
    spark = docs.sparkSession
    known = read_ledger(spark, ledger)
    addressed = with_blob(docs.select(F.col(id_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    # The path that stands for a blob is the smallest; a null path counts as its own value.
    unseen = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    if known is not None:
        unseen = unseen.join(known.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    one = addressed.hint("shuffle_hash").join(unseen.select(F.col("blob").alias("b"), F.col("path").alias("p")).hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi")
    found = one.select("blob", "text").mapInPandas(_scan, _FINDINGS)
    # A row that is there twice was scanned twice; the ledger gets each blob once.
    found.dropDuplicates(["blob"]).withColumn("rule_version", F.lit(version)).write.mode("append").parquet(ledger)
    return known_findings(spark, ledger, version).dropDuplicates(["blob"])


def known_findings(spark: SparkSession, ledger: str, version: str = RULE_VERSION) -> DataFrame:
    """The ledger's rows under a rule version. A write that was repeated, or two scans at once, may have
    left a blob twice, with equal findings."""
    return spark.read.parquet(ledger).filter(F.col("rule_version") == version).drop("rule_version")


def scan_paths(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base and spans of each row's content.

    Without ``ledger`` a new one is begun in the shared folder. Columns of ``docs`` with these names
    are replaced, others stay whatever their names. Null texts are empty; very long ones are scanned
    whole; repeated rows, and rows of equal texts, each get the same findings; an empty table stays empty.
    """
    ledger = ledger or new_path(docs.sparkSession, "ledger")
    scan(docs, ledger, id_col, text_col)
    hits = known_findings(docs.sparkSession, ledger).filter("spans <> ''").dropDuplicates(["blob"])  # most blobs have none
    names = [c for c in hits.columns if c != "blob"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_row")
    joined = docs.select(row, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("blob")).join(hits, "blob", "left")
    found = [F.coalesce(c, F.lit(0) if c.startswith("n_") else F.lit("")).alias(c) for c in names]
    return joined.select(*(F.col(f"own_row.`{c}`") for c in docs.columns if c not in names), *found)


def redacted(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets of their texts replaced by their kinds; ``length_col``, where there is one, follows.

    Texts without secrets, null among them, stay as they are.
    """

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([redact(t, [(int(s), int(e), k) for k, s, e in (x.split(":") for x in found.split(","))]) if found else t for t, found in zip(texts, spans, strict=True)])

    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(id_col).alias("path_id"), F.col(text_col).alias("body"))
    found = scan_paths(own, ledger, "path_id", "body")
    changed = F.col("spans") != ""
    out = found.withColumn("masked", F.when(changed, masked("body", "spans")).otherwise(F.col("body")))
    types = dict(docs.dtypes)
    as_it_was = {c: F.col(f"own.`{c}`") for c in docs.columns}
    as_it_was[text_col] = F.col("masked")
    if length_col in types:
        as_it_was[length_col] = F.when(changed, F.length("masked").cast(types[length_col])).otherwise(F.col(f"own.`{length_col}`"))
    return out.select(*(c.alias(name) for name, c in as_it_was.items()))
