"""Operator 9 — secret scan with corpus-wide ownership frequency.

Three patterns give the base spans, always reported.  Outside them further
candidates are looked for: keys with a provider's prefix, three-part web tokens,
private key blocks, passwords in connection strings and long mixed strings, each
in text that no earlier kind holds.  Every value is hashed and its hash aggregated by
owner and repository over the whole corpus: a value that many owners hold is a
copied example, one that few hold looks live.  Live-looking candidates become
further spans of their kind.

The span of ``assign`` is the assigned value (group 2 of its pattern) and that of
``connection`` the password; ``mstart`` and ``mend`` carry the whole match.  Offsets are
code points, end exclusive.  A repository is named by a column (the id if none is given),
so rows with one id are one repository.  ``n_live`` and ``n_example`` count a row's distinct
values, whichever kinds hold them.

Defined results: null and empty texts have no span; all rows of a null owner have
one owner, of a null id one repository; equal rows are scanned one by one; texts are
scanned whole in time linear in their length; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.session import ship_package

#: owners up to which a value counts as owner-specific
LIVE_OWNERS = 2

# fixed patterns of the base kinds, and the least length of the value
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")          # the same as runs of one or more with the short ones dropped
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: further candidates in order of precedence: kind, pattern, group of the value
CANDIDATES = [
    ("provider", re.compile(r"gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,}"
                            r"|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|[rs]k_live_[A-Za-z0-9]{16,}"
                            r"|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{30,}|ASIA[A-Z0-9]{16}"), 0),
    ("webtoken", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    ("keyblock", re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[^-]+-----END (?:[A-Z0-9]+ ){0,3}"
                            r"PRIVATE KEY-----"), 0),
    ("connection", re.compile(r"://[^\s:@/]*:([^\s@/]{4,})@"), 1),
    ("live", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 0),
]
KINDS = ["assign", "access", "hex", *(kind for kind, _, _ in CANDIDATES)]
#: start, kind number, end of the value; start and end of the match
Span = tuple[int, int, int, int, int]


def _span(m: re.Match, kind: int, group: int = 0) -> Span:
    return m.start(group), kind, m.end(group), m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """The base spans, in order."""
    found = [_span(m, 0, 2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [_span(m, 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [_span(m, 2) for m in HEX.finditer(text)]
    return sorted(found)


def mixed(value: str) -> bool:
    """Digits beside letters."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def candidate_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that touch no base span and none of an earlier kind."""
    out, taken = [], None
    for number, (kind, pattern, group) in enumerate(CANDIDATES, len(LEAST)):
        for m in pattern.finditer(text):
            if kind == "live" and not mixed(m.group()):
                continue
            if taken is None:                                # a flag a code point
                taken = bytearray(len(text))
                for a, _, z, *_ in base:
                    taken[a:z] = b"\1" * (z - a)
            a, z = m.span(group)
            if taken.find(1, a, z) < 0:
                taken[a:z] = b"\1" * (z - a)
                out.append(_span(m, number, group))
    return sorted(out)


SPAN = "array<struct<start:bigint,kind:int,end:bigint,hash:string,mstart:bigint,mend:bigint>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()),
                               ("hash", pa.string()), ("mstart", pa.int64()), ("mend", pa.int64())]))

    def rows(text: str, found: list[Span]) -> list[dict]:
        return [{"start": a, "kind": k, "end": z, "mstart": ma, "mend": mz,
                 "hash": hashlib.blake2b(text[a:z].encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()}
                for a, k, z, ma, mz in found]

    for b in batches:
        base, extra = [], []
        for t in b.column("text").to_pylist():
            t = t or ""
            found = base_spans(t)
            base.append(rows(t, found))
            extra.append(rows(t, candidate_spans(t, found)))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "id", "owner", "repo")),
                                          pa.array(base, span), pa.array(extra, span)],
                                         ["rid", "id", "owner", "repo", "base", "extra"])


def ownership(values: DataFrame, live_owners: int = LIVE_OWNERS) -> DataFrame:
    """hash, owners, repositories, live of every secret value (hash, owner, repo) of the corpus."""
    by_repo = values.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories")) \
        .withColumn("live", F.col("owners") <= live_owners)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str | None = None, live_owners: int = LIVE_OWNERS) -> DataFrame:
    """id, base and spans (arrays of start, kind, end, hash, mstart, mend), n_live and n_example per row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"),
                       F.col(owner_col).cast("string").alias("owner"),
                       F.col(repo_col or id_col).cast("string").alias("repo"), F.col(text_col).alias("text"))
    scanned = stored(rows.mapInArrow(_scan, f"rid bigint, id bigint, owner string, repo string, base {SPAN}, extra {SPAN}"),
                     "secret-spans")
    every = F.concat("base", "extra")
    values = scanned.select("rid", "owner", "repo", F.explode(F.array_distinct(
        F.transform(every, lambda s: s["hash"]))).alias("hash"))
    verdict = values.join(stored(ownership(values, live_owners), "ownership"), "hash")
    per_row = verdict.groupBy("rid").agg(
        F.collect_list(F.when(F.col("live"), F.col("hash"))).alias("alive"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"))
    alive = F.map_from_arrays("alive", F.transform("alive", lambda h: F.lit(True)))
    added = F.when(F.size("extra") > 0, F.filter("extra", lambda s: alive.getItem(s["hash"]))).otherwise(F.col("extra"))
    return scanned.join(per_row, "rid", "left").select(
        "id", "base", F.array_sort(F.concat("base", added)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def span_text(column: str, start: str = "start", end: str = "end"):
    """kind:start:end of an array of spans, joined by commas in order of start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_sort(F.transform(column, lambda s: F.struct(
        s[start].alias("start"), s["kind"].alias("kind"), s[end].alias("end"))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
