"""Token counts by a map-side lookup in two tiers.

Texts are cut into pre-tokens (pretokens.py), whose token counts add up to the text's. The first tier is a table of the token counts of the FREQUENT
most frequent pre-tokens of a sample; its size is bounded, so it is broadcast. The second one is each Python worker's own cache of what the first
doesn't hold: misses of a batch of texts are encoded together, once. No pre-token is ever shuffled: the plan is a scan and one map.
The sample decides only which counts needn't be worked out; results don't depend on it.

Defined results: a null text counts as empty and has 0 bytes and 0 tokens; a null doc_id and repeated rows pass through; strings of special tokens in
a text are ordinary text; very long texts are counted whole, and pre-tokens of over LONG characters encoded without being kept; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tautline.llm.keys import column
from tautline.llm.pretokens import SPACE, encode_pretokens, load_pieces, piece_path, pretokens, read_file, worker_held

#: Pre-tokens of the broadcast table, of a worker's cache, and characters of those that are kept.
FREQUENT, CACHED, LONG = 65_536, 500_000, 64
#: Documents of the sample, those of their pre-tokens (the most frequent of each document) that count, files that the sample is taken from.
SAMPLE, OF_EACH, FILES = 5_000, 500, 16
#: Rows whose texts are held as Python strings at once, and rows of a batch that a task returns.
ROWS, BATCH = 256, 10_000
#: The limit of the query.
LIMIT = 4096


def spread_sample(docs: DataFrame) -> DataFrame:
    """About SAMPLE documents, of FILES of the Parquet files behind docs if these are more."""
    files = sorted(docs.inputFiles(), key=lambda p: zlib.crc32(p.encode()))
    some = docs.sparkSession.read.schema(docs.schema).parquet(*files[:FILES]) if len(files) > FILES else docs
    return some.sample(min(1.0, SAMPLE / max(1, some.count())), seed=7)


def frequent_pretokens(sample: DataFrame, text: str = "text") -> list[str]:
    """The FREQUENT pre-tokens that most of the sampled documents hold. Each task counts its own documents; the driver adds up, which are
    OF_EACH pre-tokens of LONG characters for each sampled document at most."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for x in batches:
            for k in range(0, len(x), ROWS):
                for t in x["text"].slice(k, ROWS).to_pylist():
                    if t:
                        seen.update([w for w, _ in Counter(w for w in pretokens(t.replace(SPACE, " ")) if len(w) <= LONG).most_common(OF_EACH)])
        words, counts = list(seen.keys()), list(seen.values())
        for k in range(0, len(words), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(words[k : k + BATCH], pa.string()), pa.array(counts[k : k + BATCH], pa.int64())], ["w", "n"])

    total: Counter = Counter()
    for batch in sample.select(column(text).alias("text")).mapInArrow(of, "w string, n long").toArrow().to_batches():
        for w, n in zip(batch["w"].to_pylist(), batch["n"].to_pylist(), strict=True):
            total[w] += n
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]


class TokenCounter:
    """Counts of tokens by pre-token: the given ones, then those that this worker has seen."""

    def __init__(self, model: bytes, given: dict[str, int]):
        self.sp, self.given, self.known = load_pieces(model), given, dict(given)

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = [pretokens(t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.known) > CACHED + len(self.given):
            self.known = dict(self.given)
        known, now = self.known, {}
        new = list({w for words in cut for w in words if w not in known})
        for w, ids in zip(new, encode_pretokens(self.sp, new), strict=True):
            (known if len(w) <= LONG else now)[w] = len(ids)
        get = (known | now).__getitem__ if now else known.__getitem__
        return [sum(map(get, words)) for words in cut]


def token_counts(docs: DataFrame, path: str, sample: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens. path: the model file, on the driver; sample: documents from which the first tier is fitted."""
    model = read_file(path)
    frequent = frequent_pretokens(spread_sample(docs) if sample is None else sample, text)
    given = {w: len(ids) for w, ids in zip(frequent, encode_pretokens(load_pieces(model), frequent), strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast((model, given))
    name = uuid.uuid4().hex

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_held("counter", name, lambda: TokenCounter(*shared.value))
        for x in batches:
            n = [c for k in range(0, len(x), ROWS) for c in counter.counts(x["text"].slice(k, ROWS).to_pylist())]
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    body = F.coalesce(column(text), F.lit(""))
    rows = docs.select(column(key).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_bytes long, n_tokens long")


def op13_tokens(spark, sf_dir: str) -> DataFrame:
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_path())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op13_tokens": op13_tokens}
