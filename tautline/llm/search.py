"""Ranked lexical search with K2-treaps over the grid of terms and documents.

Each item of a query set gets its `k` documents of the highest score: the sum, over the item's terms, of the term's weight times a saturated, length-
normalised frequency, in 64-bit integers (impact()). Steps:

- One pass over all texts writes the grid: for each document its number of terms, and which terms of the query set it holds how often. Terms are cut
  from the bytes of the text.
- Numbers of documents and terms, and of the documents that hold each term, come from the grid by aggregation.
- Each task then takes documents of the grid in ranges of CELLS cells, in the order of their doc_ids, and puts a range into a K2-treap: a quadtree
  over (term, document) in which each cell that isn't empty keeps which of its four parts aren't (a nibble; parts are found by counting bits) and
  how far its highest impact lies below that of the cell around it. Rows stand in the order of their document frequency, so that the rows of a cell
  have like impacts; they are split in the first levels, documents in all.
- For an item the paths of its rows descend jointly: a state is a range of documents with the cell of each row in it; the sum of their maxima bounds every
  score in it. Ranges are opened in the order of their bounds (then of their documents) until no bound reaches the item's k-th score. The
  k best of a task's ranges so far bound the next ones.
- The k best of each task are ranked per item, salted first: a task gives k rows for each item at most.

The query set is taken in blocks of about ITEM_BYTES of text, each of which is held on the driver and broadcast; all blocks meet all documents.

Defined results: null texts and texts without terms count for nothing; documents of a null doc_id stand before the others of the same score, and
come out with a null doc_id; rows that share a doc_id are documents of their own; items that share an item_id are one item of all their terms, null
being an item_id of its own; items without terms have no rows; terms of weight 0 count for nothing; very long texts are read whole; an empty table of either kind gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.llm.keys import column

#: Documents of an item, bytes of a block of items, cells of a treap, ranges opened at once, parts of an item before its last ranking.
TOP, ITEM_BYTES, CELLS, AT_ONCE, SALTS = 50, 4_000_000, 1_000_000, 64, 16
#: Stands for a null doc_id.
NO_ID = -(1 << 63)

find_terms = re.compile(rb"[0-9A-Za-z\x80-\xff]+").findall


def terms(text: str | None) -> list[bytes]:
    """The runs of ASCII letters and digits and of other characters than ASCII, A-Z in lower case."""
    return find_terms((text or "").encode("utf-8", "surrogatepass").lower())


def grid(docs: DataFrame, known: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (null: NO_ID), n (terms), rows and tf: the places in `known` of the document's terms, and how often it holds each."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = {t: k for k, t in enumerate(shared.value)}.get
        for x in batches:
            n, rows, tf, ends = [], [], [], [0]
            for k in range(0, len(x), 256):
                for t in x["text"].slice(k, 256).to_pylist():
                    found = terms(t)
                    n.append(len(found))
                    counts = Counter(map(row, found))
                    counts.pop(None, None)
                    rows += counts.keys()
                    tf += counts.values()
                    ends.append(len(rows))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (rows, tf)]
            yield pa.RecordBatch.from_arrays([x["doc_id"], pa.array(n, pa.int64()), *lists], ["doc_id", "n", "rows", "tf"])

    rows = docs.select(F.coalesce(column(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, n long, rows array<int>, tf array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight w that a document of n terms holds tf times adds to its score."""
    m = 50 + 50 * n * n_docs // max(1, n_terms)
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


#: Set bits of a nibble.
BITS = np.array([bin(k).count("1") for k in range(16)], np.int64)


@dataclass
class Treap:
    """Cells of all levels in one row, the root first and each level in Z-order, so that the parts of a cell follow from counting the bits before them;
    the last cell stands for all empty ones."""

    height: int
    row_shift: int  # rows are split in the first levels
    col_shift: int
    parts: np.ndarray  # a nibble for each cell: its parts that aren't empty, upper rows first
    first: np.ndarray  # place of its first part
    below: np.ndarray  # how far its maximum lies below that of the cell around it
    top: int  # the root's maximum
    held: np.ndarray  # whether the range holds a row

    @staticmethod
    def build(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_rows: int, n_cols: int) -> Treap:
        """rows, cols, values: cells, at least one, with values above 0."""
        high, wide = max(1, (n_rows - 1).bit_length()), max(1, (n_cols - 1).bit_length())
        h = max(high, wide)
        r, c = rows.astype(np.int64) << (h - high), cols.astype(np.int64) << (h - wide)
        z = np.zeros(len(r), np.int64)
        for k in range(h):
            z |= (r >> k & 1) << (2 * k + 1) | (c >> k & 1) << (2 * k)
        order = np.argsort(z)
        code, most = z[order], values[order].astype(np.int64)
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        parts = np.zeros(len(code), np.uint8)
        for _ in range(h):
            start = np.flatnonzero(np.append(True, (code[1:] >> 2) != (code[:-1] >> 2)))
            around = np.maximum.reduceat(most, start)
            below = np.repeat(around, np.diff(np.append(start, len(code)))) - most
            levels.append((parts, below.astype(np.uint32) if below.max() < 1 << 32 else below))
            parts = np.bitwise_or.reduceat(np.left_shift(1, code & 3).astype(np.uint8), start)
            code, most = code[start] >> 2, around
        levels.append((parts, np.zeros(1, np.uint32)))
        levels.reverse()
        parts = np.concatenate([*[x for x, _ in levels], np.zeros(1, np.uint8)])
        below = np.concatenate([*[x for _, x in levels], np.zeros(1, np.uint32)])
        n = BITS[parts]
        return Treap(h, h - high, h - wide, parts, (1 + np.cumsum(n) - n).astype(np.int32), below, int(most[0]), np.bincount(rows, minlength=n_rows) > 0)

    def search(self, rows: np.ndarray, ids: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """best: a heap of (score, -doc_id) with k entries at most, which the documents of this range join; ids: their doc_ids in ascending order."""
        rows = rows[self.held[rows]] << self.row_shift
        if not len(rows):
            return
        h, none = self.height, len(self.parts) - 1
        # (-bound, first document, level, cells, their maxima)
        heap = [(-self.top * len(rows), 0, 0, 0, np.zeros(len(rows), np.int64), np.full(len(rows), self.top, np.int64))]
        made = 1

        def reaches(bound: int, col: int) -> bool:
            return len(best) < k or (bound, -int(ids[col])) > best[0]

        while heap and reaches(-heap[0][0], heap[0][1]):
            opened = []
            while heap and len(opened) < AT_ONCE and reaches(-heap[0][0], heap[0][1]):
                x = heapq.heappop(heap)
                if x[3] == h:
                    entry = (-x[0], -int(ids[x[1]]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    else:
                        heapq.heapreplace(best, entry)
                else:
                    opened.append(x)
            if not opened:
                continue
            level = np.array([x[3] for x in opened])
            cells, most = np.array([x[4] for x in opened]), np.array([x[5] for x in opened])
            low = (rows[None, :] >> (h - 1 - level)[:, None] & 1) * 2
            parts, first = self.parts[cells].astype(np.int64), self.first[cells]
            for c in (0, 1):
                there = parts >> (low + c) & 1 > 0
                child = np.where(there, first + BITS[parts & ((1 << low + c) - 1)], none)
                value = np.where(there, most - self.below[child], 0)
                for i, bound in enumerate(value.sum(axis=1).tolist()):
                    if bound:
                        col = opened[i][1] + (c << (h - 1 - opened[i][3]) >> self.col_shift)
                        if reaches(bound, col):
                            made += 1
                            heapq.heappush(heap, (-bound, col, made, opened[i][3] + 1, child[i], value[i]))


def _best(cells: DataFrame, place: np.ndarray, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its place), doc_id and score of the k best documents of each task. place: the treap's row of each row of the grid."""
    shared = cells.sparkSession.sparkContext.broadcast((place, items, weights))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of, items, weights = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        held, size = [], 0

        def searched() -> None:
            ids, n, count, rows, tf = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            of = np.repeat(np.arange(len(ids)), count)
            value = impact(weights[rows], tf, n[of], n_docs, n_terms)
            some = value > 0
            if some.any():
                treap = Treap.build(rows[some], place[of][some], value[some], len(weights), len(ids))
                for x, heap in zip(items, best, strict=True):
                    treap.search(x, ids[order], k, heap)

        for x in batches:
            rows, tf = x["rows"], x["tf"]
            counts = np.diff(rows.offsets.to_numpy())
            rows, tf = place_of[rows.flatten().to_numpy()], tf.flatten().to_numpy().astype(np.int64)
            held.append((x["doc_id"].to_numpy(), x["n"].to_numpy(), counts, rows, tf))
            size += len(rows)
            if size >= CELLS:
                searched()
                held, size = [], 0
        if size:
            searched()
        of, ids, scores = [], [], []
        for i, heap in enumerate(best):
            of += [i] * len(heap)
            ids += [-x for _, x in heap]
            scores += [s for s, _ in heap]
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return cells.select("doc_id", "n", "rows", "tf").mapInArrow(of, "item int, doc_id long, score long")


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: dict[int | None, set[bytes]], k: int, key: str, text: str) -> DataFrame | None:
    """The results of items that the driver holds: the terms of each item_id."""
    known = sorted(set().union(*items.values()))
    if not known:
        return None
    cells = durable(grid(docs, known, key, text), "grid")
    n_docs, n_terms = cells.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(known), np.int64)
    for batch in cells.select(F.explode("rows").alias("row")).groupBy("row").agg(F.count("*").alias("n")).toArrow().to_batches():  # a row for each term of the block at most
        df[batch["row"].to_numpy()] = batch["n"].to_numpy()
    order = np.argsort(df, kind="stable")
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    row = dict(zip(known, place.tolist(), strict=True))
    paths = [np.array(sorted(row[t] for t in found), np.int64) for found in items.values()]
    weights = np.array([weight(n_docs, int(n)) for n in df[order]], np.int64)
    best = _best(cells, place, paths, weights, n_docs, n_terms, k)
    best = _ranked(best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), ["item", "salt"], k).drop("salt", "rank")
    names = docs.sparkSession.createDataFrame(list(enumerate(items)), "item int, item_id long")
    return _ranked(best, ["item"], k).join(F.broadcast(names), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, item_key: str = "item_id", key: str = "doc_id", text: str = "text", item_text: str = "text", block: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item, of scores above 0."""
    items = items.select(column(item_key).cast("long").alias("item_id"), F.coalesce(column(item_text), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks, out = -(-size // block), None
    for b in range(blocks):
        held: dict[int | None, set[bytes]] = {}
        for batch in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow().to_batches():
            for item_id, t in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.setdefault(item_id, set()).update(terms(t))
        part = _search_block(docs, held, k, key, text)
        out = part if out is None else out if part is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op12_search": op12_search}

_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op12_search": f"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS r, {_CUT} AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_CUT}) AS term FROM benchmark),
s AS (SELECT count(*) AS nd, CAST(sum(len(terms)) AS BIGINT) AS nt FROM cut WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM cut) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term),
m AS (SELECT r, doc_id, 50 + (50 * CAST(len(terms) AS BIGINT) * nd) // nt AS m FROM cut, s WHERE len(terms) > 0),
scored AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
}
