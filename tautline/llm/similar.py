"""Near copies of documents by an exact set-similarity join on word shingles.

A text is the set of its shingles of `size` words, with A-Z in lower case; fewer words are one shingle, none are the empty
set. Two texts are linked if their sets have a Jaccard similarity of at least SIMILAR. Steps:

- Equal sets fold into one, named by a 64-bit hash; shingles are counted in BUCKETS hashed buckets meanwhile.
- Prefix filter: the shingles of a set in the order of their buckets' counts, so many of the rarest that similar sets share
  one of them, are listed by code. The counts decide the order only: the result is the same under any order.
- First come the links of the fingerprints: sets of equal SimHash fingerprints with the least of them, and of fingerprints that
  differ by RADIUS bits at most, found by deletion variants, each with the least of its chain; and each set meets the least set of its lists. That connects most of
  a large group of near copies at a linear cost. Texts of the similarity 0.8 differ by 10 of 64 bits on average and some by
  20, for which no segment of a fingerprint is selective; so sets of one list that are not yet connected meet each other
  then. Pairs pass the length and the positional filter.
- Each candidate pair is verified on the whole sets of shingles (64-bit hashes).

No pair is lost by the filters; pairs that are connected already are not compared, which changes no component.

Defined results: a null text counts as empty, and texts without words are copies of each other; a null doc_id stands before all
others; different texts that share a doc_id follow each other in the order of their hash; very long texts are compared
whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.llm.components import connected_components
from tautline.llm.keys import few, keyed, turned
from tautline.llm.simhash import fingerprint_links
from tautline.llm.words import WORD_A, WordHash, Words, blocks, mix, window_hashes

#: The similarity as a fraction, words of a shingle, bits by which fingerprints of the first links differ, buckets for counting shingles and those that travel in one row.
SIMILAR = (4, 5)
SIZE, RADIUS = 5, 3
BUCKETS, PART = 1 << 20, 1 << 16
HASH_BITS = 56

def shingles(texts: list[str | None], size: int, hasher: WordHash) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For blocks of texts: their slice, shingle hashes and the text (from 0 in the block) of each, by text; repeats included."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    for part in blocks([len(t) for t in raw]):
        w = Words(raw[part])
        h = hasher.of(w)
        n = np.diff(w.bounds)
        whole = window_hashes(h, size)
        inside = w.text[: len(whole)] == w.text[size - 1 : size - 1 + len(whole)]
        few = np.flatnonzero((n > 0) & (n < size))
        short = np.array([window_hashes(np.append(h[w.bounds[k] : w.bounds[k + 1]], np.uint64(n[k])), int(n[k]) + 1)[0] for k in few], np.uint64)
        of, got = np.append(w.text[: len(whole)][inside], few), np.append(whole[inside], short)
        order = np.argsort(of, kind="stable")
        yield part, got[order], of[order]


def _distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted by text and value."""
    order = np.lexsort((values, of))
    v, t = values[order], of[order]
    new = np.append(True, (v[1:] != v[:-1]) | (t[1:] != t[:-1]))[: len(v)]
    return v[new], t[new]


def _names(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set from its hashes, which are distinct and sorted by set."""
    sums = np.append(np.uint64(0), np.cumsum(mix(h)))
    ends = np.cumsum(n)
    return mix((sums[ends] - sums[ends - n]) ^ mix(n.astype(np.uint64))).view(np.int64)


def _fingerprints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The majority of each bit of the hashes of each text, repeats included."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums, some = np.zeros((len(n), 64), np.int64), n > 0
    if some.any():
        sums[some] = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
    return np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<i8").ravel()


def _named(rows: DataFrame, size: int) -> DataFrame:
    """key, turn, sid and n (the name and size of its set) and fp of each row, and rows part and counts: compressed counts of PART buckets."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, counts = WordHash(WORD_A), np.zeros(BUCKETS, np.int64)
        for x in batches:
            for part, h, t in shingles(x["text"].tolist(), size, hasher):
                fp = _fingerprints(h, np.bincount(t, minlength=part.stop - part.start))
                h, t = _distinct(h, t)
                n = np.bincount(t, minlength=part.stop - part.start)
                counts += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                yield pd.DataFrame({"key": x["key"].to_numpy()[part], "turn": x["turn"].to_numpy()[part], "sid": _names(h, n), "n": n.astype(np.int32), "fp": fp, "part": np.int32(-1), "counts": None})
        if counts.any():
            parts = range(0, BUCKETS, PART)
            yield pd.DataFrame({"key": np.int64(0), "turn": np.int64(0), "sid": np.int64(0), "n": np.int32(0), "fp": np.int64(0), "part": np.arange(len(parts), dtype=np.int32), "counts": [zlib.compress(counts[k : k + PART].astype("<i8").tobytes(), 1) for k in parts]})

    return rows.mapInPandas(of, "key long, turn long, sid long, n int, fp long, part int, counts binary")


def _rarities(parts: DataFrame) -> np.ndarray:
    """One byte for each bucket: four times the binary logarithm of its shingles' count."""

    def total(x: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(zlib.decompress(c), "<i8") for c in x["counts"])
        rare = np.minimum(4 * np.log2(1 + counts), 126).astype(np.uint8)
        return pd.DataFrame({"part": x["part"][:1], "rare": [rare.tobytes()]})

    out = np.zeros(BUCKETS, np.uint8)
    for r in parts.groupBy("part").applyInPandas(total, "part int, rare binary").collect():  # BUCKETS bytes
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.rare, np.uint8)
    return out


def _postings(rows: DataFrame, size: int, rare: np.ndarray) -> DataFrame:
    """code, sid, n, pos of the rarest shingles of each set."""
    a, b = SIMILAR
    packed = zlib.compress(rare.tobytes())

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, table = WordHash(WORD_A), np.frombuffer(zlib.decompress(packed), np.uint8)
        for x in batches:
            for part, h, t in shingles(x["text"].tolist(), size, hasher):
                h, t = _distinct(h, t)
                n = np.bincount(t, minlength=part.stop - part.start)
                sid = _names(h, n)
                code = (table[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS)) | (h & np.uint64((1 << HASH_BITS) - 1))
                code = code[np.lexsort((code, t))]
                pos = np.arange(len(t)) - (np.cumsum(n) - n)[t]
                here = pos < (n - -(-a * n // b) + 1)[t]
                t = t[here]
                yield pd.DataFrame({"code": code[here].view(np.int64), "sid": sid[t], "n": n[t].astype(np.int32), "pos": pos[here].astype(np.int32)})

    return rows.mapInPandas(of, "code long, sid long, n int, pos int")


def _filters(n: Column, m: Column, p: Column, q: Column) -> Column:
    """Length and positional filter of sets of n and m shingles that share one at the places p and q."""
    a, b = SIMILAR
    return (b * n >= a * m) & (b * m >= a * n) & ((a + b) * F.least(n - p, m - q) >= a * (n + m))


def _verified(pairs: DataFrame, rows: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """Those pairs a, b of sets that have the similarity."""
    a, b = SIMILAR
    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "wanted")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHash(WORD_A)
        for x in batches:
            for part, h, t in shingles(x["text"].tolist(), size, hasher):
                h, t = _distinct(h, t)
                n = np.bincount(t, minlength=part.stop - part.start)
                ends = np.cumsum(n)
                yield pd.DataFrame({"sid": _names(h, n), "hashes": [h[e - k : e].tobytes() for e, k in zip(ends, n)]})

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            hit = []
            for u, v in zip(x["x"], x["y"]):
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                hit.append((a + b) * len(np.intersect1d(u, v, assume_unique=True)) >= a * (len(u) + len(v)))
            yield x.loc[np.array(hit, bool), ["a", "b"]]

    wanted = few(wanted)
    keys = wanted.join(reps, "sid").select("first.*")
    texts = rows.join(few(durable(keys, "wanted-texts")), ["key", "turn"], "left_semi").mapInPandas(sets, "sid long, hashes binary")
    held = durable(texts.join(wanted, "sid", "left_semi"), "held")
    both = pairs.join(held.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a").join(held.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b")
    return durable(both.select("a", "b", "x", "y").mapInPandas(similar, "a long, b long"), "similar")


def _simhash_links(reps: DataFrame) -> DataFrame:
    """Pairs a < b of sets of equal or near fingerprints, each such group of sets connected through its least."""
    fps = durable(reps.filter("n > 0").groupBy("fp").agg(F.min("sid").alias("lead")), "fingerprints")
    equal = reps.filter("n > 0").join(fps, "fp").filter("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    near = connected_components(durable(fingerprint_links(fps.select("fp"), RADIUS), "near-fingerprints")).filter("node <> component")
    of = lambda s: fps.select(F.col("fp").alias(s), F.col("lead").alias(s + "_lead"))
    near = near.join(of("node"), "node").join(of("component"), "component")
    return equal.union(near.select(F.least("node_lead", "component_lead"), F.greatest("node_lead", "component_lead")))


def _links(shared: DataFrame, rows: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """shared: code, sid, n, pos and lead (sid, n, pos) of codes that several sets have. Pairs a, b that connect all similar sets."""
    led = shared.filter(F.col("sid") != F.col("lead.sid")).filter(_filters(F.col("n"), F.col("lead.n"), F.col("pos"), F.col("lead.pos")))
    led = durable(led.select(F.col("lead.sid").alias("a"), F.col("sid").alias("b")).union(_simhash_links(reps)).distinct(), "led")
    one = _verified(led, rows, reps, size)
    comps = connected_components(one).withColumnRenamed("node", "sid")
    comps = few(comps)
    of_code = Window.partitionBy("code")
    rest = shared.join(comps, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    rest = rest.withColumns({"low": F.min("component").over(of_code), "high": F.max("component").over(of_code)})
    rest = durable(rest.filter(F.col("low") != F.col("high")).filter(F.col("sid") != F.col("lead.sid")).select("code", "sid", "n", "pos", "component"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    apart = (F.col("x.code") == F.col("y.code")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.component") != F.col("y.component"))
    met = x.join(y, apart & _filters(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")))
    met = met.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct().join(led, ["a", "b"], "left_anti")
    return one.union(_verified(durable(met, "met"), rows, reps, size))


def _components(rows: DataFrame, size: int) -> DataFrame:
    """rows: key, turn (which name a row), text. key, turn and first (key and turn of the first row of its component)."""
    found = durable(_named(rows, size), "sets")
    sets = found.filter("part < 0")
    reps = durable(sets.groupBy("sid").agg(F.min(F.struct("key", "turn")).alias("first"), F.max("n").alias("n"), F.min("fp").alias("fp")), "reps")
    firsts = reps.filter("n > 0").select("first.*")
    posted = _postings(rows.join(firsts, ["key", "turn"], "left_semi"), size, _rarities(found.filter("part >= 0")))
    of_code = Window.partitionBy("code")
    shared = posted.withColumns({"lead": F.min(F.struct("sid", "n", "pos")).over(of_code), "last": F.max("sid").over(of_code)})
    shared = durable(shared.filter(F.col("lead.sid") != F.col("last")).drop("last"), "shared")
    comps = connected_components(_links(shared, rows, reps, size)).withColumnRenamed("node", "sid")
    nodes = durable(reps.join(comps, "sid", "left").select("sid", "first", F.coalesce("component", "sid").alias("component")), "nodes")
    ids = nodes.groupBy("component").agg(F.min("first").alias("first"))
    return sets.join(nodes.select("sid", "component").join(ids, "component").select("sid", "first"), "sid").select("key", "turn", "first")


def later_copies(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows: key, turn (which name a row), text. key and turn of the rows that are not the first of their component."""
    return _components(rows, size).filter(F.struct("key", "turn") != F.col("first")).select("key", "turn")


def near_copies(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id, the first doc_id of those connected by links of similar texts, for each different row."""
    _, once = turned(keyed(docs, key, text))
    named = lambda c: F.when(F.col(c) >= -(1 << 62), F.col(c))
    return _components(once, size).select(named("key").alias("doc_id"), named("first.key").alias("component_id"))
