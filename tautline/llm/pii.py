"""Personal data by candidate gradient boosting.

Base spans (email, ip, card, phone) come from fixed formats with a check. Beside them generators of high recall
propose overlapping candidates: `address` (anything shaped like one with an at sign or its disguise), `number` (any run of
digit groups) and `code` (two letters, two check digits, groups). Boosted trees score each candidate by features of its
format and its context. A candidate that overlaps no base span becomes a span of kind `other` where its score reaches the
threshold of its generator.

The trees are fitted with MLlib on all weakly labelled candidates of the table; equal ones are one row with their number as its weight. Positive:
candidates that a base check accepts, base spans in another guise (a phone number without its plus, an address with
a written at), codes whose check digits hold. Negative: spans of a base format that fail its check, base spans turned into
dates, amounts, versions and ranges, codes whose check digits don't hold. Candidates of which neither is known have no
label and take no part. Scores are calibrated by isotonic regression, for each generator, on all labelled candidates again, each one
scored by trees that were fitted without its fold, equal scores together; the threshold is the least score whose calibrated precision reaches
PRECISION. Scores are rounded down to STEPS steps, so that their counts, which the driver sees, have a bound.

Defined results: a null text counts as empty and has no span; a null doc_id is kept; repeated rows come out as often as
they went in; of candidates that overlap each other all that reach the threshold come out; equal scores are judged alike;
where the candidates outside of a fold are of one class only, no trees are fitted and base spans alone result, and a generator without
labelled candidates adds none; very long texts are scanned whole, in time proportional to their length; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.llm.keys import column

#: The base kinds in the order in which they stand, and their formats (without retries that can't match).
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The generators of candidates.
GENERATORS = ("address", "number", "code")
AT = re.compile(r"\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]{2,}+)++")
NUMBER = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ().\-/]{0,3}[0-9])++")
CODE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,}+(?: ?[A-Z0-9]{1,3})?")
CUES = re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|mail|contact|card|visa|account|iban|ssn|passport|ip|address|host)\b")
SIGNS = re.compile(r"[0-9@]|[\[(]at[\])]")

#: Folds of the labelled candidates, steps of a score, least digits of a number, the calibrated precision asked for.
FOLDS, STEPS, LEAST_DIGITS, PRECISION = 2, 10_000, 7, 0.95
#: Different labelled candidates in a part of the fit.
PART = 50_000


def luhn(digits: str) -> bool:
    doubled = [int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in doubled)) % 10 == 0


def mod97(code: str) -> bool:
    """Whether the check digits of a code of letters and digits hold."""
    c = code.replace(" ", "")
    value = 0
    for x in c[4:] + c[:4]:
        v = int(x, 36)
        value = (value * (100 if v > 9 else 10) + v) % 97
    return value == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _left(text: str, at: int, low: int) -> int:
    """Where the run of address characters begins that ends at `at`, not before low."""
    while at > low and text[at - 1] in LOCAL:
        at -= 1
    return at


def emails(text: str) -> Iterator[tuple[int, int]]:
    low = 0
    for m in DOMAIN.finditer(text):
        a = _left(text, m.start(), low)
        if a < m.start():
            low = m.end()
            yield a, low


def formats(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(start, kind's place, end, whether the check holds) of every match of a base format."""
    if "@" in text:
        yield from ((a, 0, b, True) for a, b in emails(text))
    yield from ((m.start(), 1, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) for m in IP.finditer(text))
    yield from ((m.start(), 2, m.end(), 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)) for m in CARD.finditer(text))
    if "+" in text:
        yield from ((m.start(), 3, m.end(), 9 <= len(digits_of(m[0])) <= 15) for m in PHONE.finditer(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), leftmost and not overlapping within a kind."""
    return sorted(x[:3] for x in formats(text) if x[3])


def features(value: str, before: str, after: str, generator: int) -> list[float]:
    """Of the format of a candidate and its context."""
    d, groups = digits_of(value), re.findall(r"[0-9]+", value)
    sizes = [len(g) for g in groups] or [0]
    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    return [
        float(x)
        for x in (
            generator, len(value), len(d), sum(c.isalpha() for c in value), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], value.count("."), value.count("-"), value.count(" "),
            value.count("/"), "(" in value, "+" in value[:1], "@" in value, "[at]" in value or "(at)" in value, "dot]" in value or "dot)" in value, 12 <= len(d) <= 19 and luhn(d),
            len(groups) == 4 and max(sizes) <= 3, year, value[:1].isupper(), generator == 2 and mod97(value), before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ("$", "€", "£", "#", "="),
            bool(CUES.search(before)), bool(re.search(r"[0-9]", before[-8:] + after[:8])),
        )
    ]


def guises(value: str, kind: int) -> list[tuple[int, str, float]]:
    """(generator, form, label): base spans in other forms."""
    d = digits_of(value)
    if kind == 0:
        return [(0, value.replace("@", " [at] "), 1.0), (0, value.replace("@", "(at)").replace(".", " [dot] "), 1.0), (0, value.replace("@", " @ "), 1.0)]
    if kind == 3:
        bare = re.sub(r"^\+[0-9]+[ .-]?", "", value) if re.search(r"[ .(-]", value) else value[2:]
        return [(1, bare, 1.0), (1, re.sub(r"[-. ]+", ".", bare), 1.0), (1, re.sub(r"[-. ]+", " ", bare), 1.0), (1, f"{d[:4]}-{d[4:8]}", 0.0)]
    if kind == 2:
        return [(1, value[:-1] + str((int(value[-1]) + 5) % 10), 0.0), (1, f"20{d[1:3]}-{1 + int(d[3]) % 9:02}-{10 + int(d[4]) % 9}", 0.0), (1, f"{d[:5]}.{d[5:9]}", 0.0)]
    return [(1, ".".join(value.split(".")[:3]) + ".12345", 0.0), (1, d + "000.00", 0.0), (1, f"19{d[:2]:0<2}-20{d[-2:]:0>2}", 0.0)]


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, generator)."""
    low = 0
    for m in AT.finditer(text):
        a = _left(text, m.start(), low)
        if a < m.start():
            low = m.end()
            yield a, low, 0
    whole = lambda m: not re.match("[A-Za-z0-9]", text[m.end() : m.end() + 1])
    yield from ((m.start(), m.end(), 1) for m in NUMBER.finditer(text) if whole(m) and len(digits_of(m[0])) >= LEAST_DIGITS)
    yield from ((m.start(), m.end(), 2) for m in CODE.finditer(text) if whole(m))


def labelled(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """The base spans, and candidates: start, end, generator, label (-1: unknown), own (overlaps no base span), features."""
    every = sorted(formats(text))
    base = [x[:3] for x in every if x[3]]
    failed = {(a, b) for a, _, b, ok in every if not ok}
    ends: list[int] = []  # the furthest end of the base spans up to each, by start
    for x in base:
        ends.append(max(x[2], ends[-1] if ends else 0))
    starts = [x[0] for x in base]
    around = lambda a, b: (text[max(0, a - 40) : a], text[b : b + 12])
    out = []
    for a, b, g in sorted(set(candidates(text))):
        k = bisect_left(starts, b)
        own = k == 0 or ends[k - 1] <= a
        if not own:
            label = 1.0
        elif g == 2:
            label = float(mod97(text[a:b]))
        else:
            label = 0.0 if (a, b) in failed else -1.0
        out.append({"start": a, "end": b, "generator": g, "label": label, "own": own, "features": features(text[a:b], *around(a, b), g)})
    for a, kind, b in base:
        for g, value, label in guises(text[a:b], kind):
            out.append({"start": a, "end": -1, "generator": g, "label": label, "own": False, "features": features(value, *around(a, b), g)})
    return base, out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (array of structs), found (array of candidates)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for t in x["text"]:
                base, found = labelled(t) if SIGNS.search(t) else ([], [])
                n = Counter(s[1] for s in base)
                rows.append((n[0], n[1], n[2], n[3], [{"start": a, "ord": k, "span": f"{KINDS[k]}:{a}:{b}"} for a, k, b in base], found))
            yield pd.concat([x[["doc_id"]], pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "found"], index=x.index)], axis=1)

    rows = docs.select(column(key).cast("long").alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    kinds = "base array<struct<start:long,ord:int,span:string>>, found array<struct<start:long,end:long,generator:int,label:double,own:boolean,features:array<double>>>"
    return rows.mapInPandas(of, f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, {kinds}")


def calibrated_threshold(held: list[tuple], precision: float) -> float:
    """The least score from which on the isotonic fit of labels by score reaches `precision`; 2 where none does. held: (score, label), or (score, label, how many)."""
    score: dict[float, list[int]] = {}
    for p, y, *n in held:
        both = score.setdefault(p, [0, 0])
        both[0] += int(y) * (n[0] if n else 1)
        both[1] += n[0] if n else 1
    pools: list[list] = []  # score, labels, count: means that never fall
    for p in sorted(score):
        pools.append([p, *score[p]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, y, n = pools.pop()
            pools[-1][1] += y
            pools[-1][2] += n
    return next((p for p, y, n in pools if y >= precision * n), 2.0)


def known(found: DataFrame) -> DataFrame:
    """The labelled ones of found (doc_id, start, end, generator, label, features), all of them: fold, generator, label, features, n (equal ones)."""
    fold = F.pmod(F.xxhash64("doc_id", "start", "end", "features"), F.lit(FOLDS)).cast("int")
    return found.filter("label >= 0").groupBy(fold.alias("fold"), "generator", "label", "features").agg(F.count("*").alias("n"))


def trees(rows: DataFrame) -> GBTClassificationModel | None:
    """The boosted trees of rows of known(). MLlib looks for splits in max(maxBins ** 2, 10000) rows drawn at random, so that maxBins has to grow with the
    rows for it to look at all of them; a feature has as many bins as values at most. Every level of every tree is a shuffle: few rows have few parts."""
    n = rows.count()
    if rows.select("label").distinct().count() < 2:
        return None
    order = ("features", "generator", "label", "fold")
    rows = rows.coalesce(1 + n // PART).sortWithinPartitions(*order).withColumn("features", array_to_vector("features"))
    return GBTClassifier(maxIter=15, maxDepth=4, seed=1, weightCol="n", maxBins=max(32, 1 + math.isqrt(n))).fit(rows)


def scores(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows.withColumn("features", array_to_vector("features"))).withColumn("p", F.floor(vector_to_array("probability")[1] * STEPS) / STEPS)


def fit(found: DataFrame, precision: float = PRECISION) -> tuple[GBTClassificationModel | None, list[float]]:
    """The boosted trees and the threshold of each generator; found: doc_id, start, end, generator, label, features."""
    rows = durable(known(found), "pii-known")
    parts = [trees(rows.filter(F.col("fold") != k)) for k in range(FOLDS)]
    if None in parts:
        return None, []
    left_out = [scores(m, rows.filter(F.col("fold") == k)).select("generator", "p", "label", "n") for k, m in enumerate(parts)]
    counts = reduce(DataFrame.union, left_out).groupBy("generator", "p", "label").agg(F.sum("n").alias("n")).collect()  # two labels of STEPS + 1 scores at most, for each generator
    return trees(rows), [calibrated_threshold([(r.p, r.label, r.n) for r in counts if r.generator == g], precision) for g in range(len(GENERATORS))]


def personal_data(docs: DataFrame, precision: float = PRECISION, **names) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (array of spans), spans (array: base and further ones)."""
    rows = durable(scan(docs, **names).withColumn("row", F.monotonically_increasing_id()), "pii")
    found = rows.filter(F.size("found") > 0).select("row", "doc_id", F.explode("found").alias("f")).select("row", "doc_id", "f.*")
    model, thresholds = fit(found, precision)
    texts = lambda c: F.transform(F.array_sort(c), lambda x: x["span"])
    if model is None:
        return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", texts("base").alias("base"), texts("base").alias("spans"))
    scored = scores(model, found.filter("own"))
    scored = scored.filter(F.col("p") >= F.element_at(F.array(*map(F.lit, thresholds)), F.col("generator") + 1))
    span = F.struct("start", F.lit(len(KINDS)).alias("ord"), F.concat_ws(":", F.lit("other"), "start", "end").alias("span"))
    more = scored.groupBy("row").agg(F.collect_set(span).alias("more"))
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return rows.join(more, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", texts("base").alias("base"), texts(every).alias("spans"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


QUERIES = {"op6_pii": op6_pii}
