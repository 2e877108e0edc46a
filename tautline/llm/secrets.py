"""Secret scans with corpus-wide ownership frequency.

Each text is scanned once for the base kinds (assign, access, hex) and for looser candidates: values with a well-known
prefix, private key blocks, and mixed strings of high entropy. The value of every span is hashed, and the hashes are
aggregated over the corpus by distinct owners and repositories. A value that WIDE_OWNERS owners have, or several owners in
WIDE_REPOS repositories, is a widely copied example; one of a single owner that looks random, in whatever number of that
owner's repositories, is taken for a live credential. Loose candidates become spans of kind `live` only in the second
case; base spans always stay and are merely classed. What is found at a place depends on the text of the candidate and
on nothing around it but its neighbouring characters.

Defined results: a null text counts as empty and has no span; a null owner or repository counts as one unnamed owner; a
null doc_id is kept, and spans are joined by row, not by doc_id; repeated rows count once as owners and come out as often as
they went in; of loose candidates that overlap the one of the earlier generator stays (prefix, key block, mixed string), and
none that overlaps a base span; very long texts and values are scanned whole, in time proportional to their length; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.llm.keys import column

#: The base kinds in the order in which they stand, and value prefixes of well-known services.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
PREFIXED = re.compile(
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{16,})"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
)
BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )*?PRIVATE KEY-----[A-Za-z0-9+/=\s]++(?:-----END (?:[A-Z]+ )*?PRIVATE KEY-----)?")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")

#: A value is widely copied from so many owners on, or with several owners from so many repositories on; a mixed string
#: looks random from so many bits a character on, another value from LEAST_BITS on.
WIDE_OWNERS, WIDE_REPOS, RANDOM_BITS, LEAST_BITS = 3, 4, 3.5, 2.5

Span = tuple[int, int, int, str]  # start, kind's place, end, value


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds: leftmost, not overlapping within a kind."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places without overlap that cover the same characters, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _random(value: str) -> bool:
    return bool(re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)) and entropy(value) >= RANDOM_BITS


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Further candidates that no base span and no candidate of an earlier generator overlaps."""
    taken = _united([(x[0], x[2]) for x in base])
    out: list[Span] = []
    for pattern, holds in ((PREFIXED, None), (BLOCK, None), (MIXED, _random)):
        starts = [a for a, _ in taken]
        more = []
        for m in pattern.finditer(text):
            k = bisect_right(starts, m.start())
            clear = (k == 0 or taken[k - 1][1] <= m.start()) and (k == len(taken) or starts[k] >= m.end())
            if clear and (holds is None or holds(m[0])):
                more.append((m.start(), 3, m.end(), m[0]))
        out += more
        taken = _united([*taken, *[(x[0], x[2]) for x in more]]) if more else taken
    return sorted(out)


def _name(x: Span) -> str:
    return f"{(*KINDS, 'live')[x[1]]}:{x[0]}:{x[2]}"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """doc_id, owner, repo, n_assign, n_access, n_hex, base, found (array of structs)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for t in x["text"]:
                base = base_spans(t)
                n = Counter(s[1] for s in base)
                found = [
                    {"start": s[0], "ord": s[1], "span": _name(s), "hash": hashlib.sha256(s[3].encode("utf-8", "surrogatepass")).hexdigest(), "random": entropy(s[3]) >= LEAST_BITS}
                    for s in [*base, *loose_spans(t, base)]
                ]
                rows.append((n[0], n[1], n[2], ",".join(map(_name, base)), found))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "found"], index=x.index)
            yield pd.concat([x[["doc_id", "owner", "repo"]], out], axis=1)

    rows = docs.select(
        column(key).cast("long").alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"),
        F.coalesce(owner if owner is not None else F.col("source"), F.lit("")).alias("owner"), F.coalesce(repo if repo is not None else F.concat_ws("/", "source", "lang"), F.lit("")).alias("repo"),
    )
    found = "array<struct<start:long,ord:int,span:string,hash:string,random:boolean>>"
    return rows.mapInPandas(of, f"doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base string, found {found}")


def spread(each: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos of every value."""
    return each.select("hash", "owner", "repo").distinct().groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.count("*").alias("n_repos"))


def secret_scan(docs: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS, **names) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans (array: base and live ones), n_examples (spans of widely copied
    values), n_owner_specific (spans of random-looking values of one owner), most_owners and most_repos (of any of its values),
    values (array of structs: start, span, hash, n_owners, n_repos, verdict)."""
    rows = durable(scan(docs, **names).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    live = (F.col("n_owners") == 1) & F.col("random")
    wide = (F.col("n_owners") >= wide_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= wide_repos))
    verdict = F.when(live, F.lit("owner-specific")).when(wide, F.lit("example")).otherwise(F.lit("unclear"))
    judged = each.join(spread(each), "hash").withColumn("verdict", verdict).filter((F.col("ord") < len(KINDS)) | (F.col("verdict") == "owner-specific"))
    judged = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "ord", "span", "hash", "n_owners", "n_repos", "verdict"))).alias("values"),
        *[F.sum((F.col("verdict") == v).cast("long")).alias(c) for v, c in (("example", "n_examples"), ("owner-specific", "n_owner_specific"))],
        F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"),
    )
    counts = ["n_examples", "n_owner_specific", "most_owners", "most_repos"]
    none = F.array().cast("array<struct<start:bigint,ord:int,span:string,hash:string,n_owners:bigint,n_repos:bigint,verdict:string>>")
    out = rows.join(judged, "row", "left").withColumn("values", F.coalesce("values", none))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.col("values.span").alias("spans"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], "values")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    out = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), "n_examples", "n_owner_specific", "most_owners", "most_repos",
    )


QUERIES = {"op1_secrets": op1_secrets}
