"""Cross-tokenizer alignment: which tokens of a byte-level BPE model (A) and of a SentencePiece model (B) cover the same bytes of a text.

Both encode a text with a space before it. Where tokens of both end, the text is cut into groups; within a group each A token is linked to the B tokens
whose bytes it overlaps. Steps:

- Texts are cut into pre-tokens (pretokens.py), at whose ends tokens of both end, so that a pre-token's groups don't depend on the rest. Each
  Python worker encodes and aligns a pre-token once: dictionaries from cumulative ends to places for A and B, the intersection of their
  keys as sets, sorted; these keys slice both id lists into groups, and links are expanded in each slice.
- One pass over the texts writes a row for each document: counts, the digest of its groups, and its distinct id pairs with their numbers. With
  them go, for each task, its id pairs with the number of documents that hold them: sums that follow the vocabularies, not the tokens.
- These are added up by id pair. The table of all id pairs travels to the executors in slices of A ids with PAIRS pairs at most (of one A id
  alone there are as many as B has ids), and each slice adds its part to the sums of every document; one slice is one more pass over the rows written.

Defined results: texts that are null or empty, or whose tokens' bytes differ from space+text, have no tokens: zeros, an empty digest, and no id pairs
that count; a null doc_id passes through; repeated rows are documents of their own and count each; strings of special tokens in a text are ordinary
text; very long texts are aligned whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.llm.bpe import byte_symbols
from tautline.llm.keys import column
from tautline.llm.pretokens import SPACE, encode_pretokens, load_pieces, piece_path, pretokens, read_file, worker_held

#: Pre-tokens that a worker keeps, characters of texts that are aligned at once, id pairs that a worker adds up at once, those of a slice of the table.
CACHED, CHARS, HELD, PAIRS = 400_000, 2_000_000, 1_000_000, 4_000_000
#: Bits of an id of B in an id pair.
B_BITS = 16


def token_bytes_a(model: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level BPE model (of special ones: none)."""
    vocabulary, at = json.loads(model)["model"]["vocab"], byte_symbols()
    out = [b""] * (max(vocabulary.values()) + 1)
    for t, i in vocabulary.items():
        out[i] = bytes(at[c] for c in t) if all(c in at for c in t) else b""
    return out


def token_bytes_b(sp) -> list[bytes]:
    """The bytes of each id of a SentencePiece model."""
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace(SPACE, " ").encode() for k in range(sp.get_piece_size()) for p in [sp.id_to_piece(k)]]


def aligned(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> tuple[list[int], list[str], list[int]]:
    """The groups of two id lists with their cumulative ends: where each ends, as text, and the id pairs of the links."""
    at_a, at_b = dict(zip(ends_a, range(1, len(a) + 1))), dict(zip(ends_b, range(1, len(b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    name_a, name_b = list(map(str, a)), list(map(str, b))
    groups, links, i, j = [], [], 0, 0
    for end in common:
        p, q = at_a[end], at_b[end]
        if p - i == 1 == q - j:
            groups.append(f"{name_a[i]}|{name_b[j]}")
            links.append(a[i] << B_BITS | b[j])
        else:
            groups.append(f"{','.join(name_a[i:p])}|{','.join(name_b[j:q])}")
            while i < p and j < q:  # the token that ends first gives way to the next one; both at once only at the group's end
                links.append(a[i] << B_BITS | b[j])
                i, j = i + (ends_a[i] <= ends_b[j]), j + (ends_b[j] <= ends_a[i])
        i, j = p, q
    return common, groups, links


def _fitting(words: list[bytes], ids: list[list[int]], of_id: list[bytes], long: np.ndarray) -> np.ndarray:
    """Whether the bytes of each word's ids are the word's. long: how many bytes each id has."""
    flat = list(itertools.chain.from_iterable(ids))
    upto, ends = np.append(0, np.cumsum(long[flat])), np.cumsum([len(x) for x in ids])
    if (np.diff(upto[ends], prepend=0) == [len(w) for w in words]).all() and b"".join(map(of_id.__getitem__, flat)) == b"".join(words):
        return np.ones(len(words), bool)
    return np.array([b"".join([of_id[i] for i in x]) == w for x, w in zip(ids, words, strict=True)], bool)


class Aligner:
    """Aligns texts, remembering pre-tokens."""

    def __init__(self, model_a: bytes, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(model_a.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = load_pieces(model_b)
        self.bytes_a, self.bytes_b = token_bytes_a(model_a), token_bytes_b(self.b)
        self.long_a, self.long_b = (np.array([len(x) for x in of_id], np.int64) for of_id in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.empty((0, 5), np.int64)  # A tokens, B tokens, groups, links, whether the bytes are the pre-token's
        self.links = np.empty(0, np.int64)
        self.begin = np.zeros(1, np.int64)  # of the links of each pre-token, and their end
        self.used = np.empty(0, np.int64)

    def thin_out(self) -> None:
        """Keeps the half of the pre-tokens that was used most."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHED // 2])
        words, n = list(self.number), self.sizes[keep, 3]
        self.links = self.links[np.arange(n.sum()) + np.repeat(self.begin[keep] - (np.cumsum(n) - n), n)]
        self.begin, self.sizes, self.used = np.append(0, np.cumsum(n)), self.sizes[keep], self.used[keep] // 2
        self.groups = [self.groups[k] for k in keep.tolist()]
        self.number = {words[k]: i for i, k in enumerate(keep.tolist())}

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        a, b = [x.ids for x in self.a.encode_batch(words, add_special_tokens=False)], encode_pretokens(self.b, words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        fit = _fitting(raw, a, self.bytes_a, self.long_a) & _fitting(raw, b, self.bytes_b, self.long_b)
        some = np.flatnonzero(fit).tolist()
        flat = [list(itertools.chain.from_iterable(x[k] for k in some)) for x in (a, b)]
        ends, groups, found = aligned(flat[0], np.cumsum(self.long_a[flat[0]]).tolist(), flat[1], np.cumsum(self.long_b[flat[1]]).tolist())
        # a word's end is a group's end
        upto = np.searchsorted(np.array(ends, np.int64), np.cumsum([len(raw[k]) for k in some]), "right")
        sizes = np.zeros((len(words), 5), np.int64)
        sizes[:, 0], sizes[:, 1], sizes[:, 4] = list(map(len, a)), list(map(len, b)), fit
        sizes[some, 2] = np.diff(upto, prepend=0)
        sizes[some, 3] = sizes[some, 0] + sizes[some, 1] - sizes[some, 2]
        of_word = dict(zip(some, itertools.pairwise([0, *upto.tolist()]), strict=True))
        self.number.update(zip(words, range(len(self.groups), len(self.groups) + len(words)), strict=True))
        self.groups += [";".join(groups[slice(*of_word.get(k, (0, 0)))]) for k in range(len(words))]
        self.begin = np.append(self.begin, len(self.links) + np.cumsum(sizes[:, 3]))
        self.sizes, self.links, self.used = np.concatenate([self.sizes, sizes]), np.append(self.links, np.array(found, np.int64)), np.append(self.used, np.zeros(len(words), np.int64))

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of each text and the digest of its groups; the text, the id pair and the number of links of each distinct id pair of each text, by text and pair."""
        cut = [pretokens(t) if t else [] for t in texts]
        if len(self.groups) > CACHED:
            self.thin_out()
        number = self.number
        self.learn(list({w for words in cut for w in words if w not in number}))
        numbers = [[number[w] for w in words] for words in cut]
        groups, sizes = self.groups, self.sizes
        of = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
        flat = np.fromiter(itertools.chain.from_iterable(numbers), np.int64, len(of))
        self.used += np.bincount(flat, minlength=len(groups))
        total = np.zeros((len(texts), 5), np.int64)
        if len(of):
            begun, first = np.unique(of, return_index=True)
            total[begun] = np.add.reduceat(sizes[flat], first, axis=0)
            total[begun, 4] = np.logical_and.reduceat(sizes[flat, 4] > 0, first)
        fit = total[:, 4] > 0
        total[~fit] = 0
        digests = [hashlib.sha256(";".join([groups[k] for k in x]).encode()).hexdigest() if ok else "" for x, ok in zip(numbers, fit.tolist(), strict=True)]
        here = fit[of]
        word, times = np.unique(of[here] << 32 | flat[here], return_counts=True)
        of, word = word >> 32, word & 0xFFFFFFFF
        n = sizes[word, 3]
        link = np.arange(n.sum()) + np.repeat(self.begin[word] - (np.cumsum(n) - n), n)
        pair, at = np.unique(np.repeat(of, n) << 32 | self.links[link], return_inverse=True)
        return total[:, :4], digests, pair >> 32, pair & 0xFFFFFFFF, np.bincount(at, np.repeat(times, n), len(pair)).astype(np.int64)


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted id pairs as differences, then their numbers."""
    return bytes(pa.compress(np.concatenate([np.diff(pairs, prepend=0), times]).astype("<u4").tobytes(), codec="zstd"))


def _unpacked(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd"), "<u4").astype(np.int64)
    return np.cumsum(x[:n]), x[n:]


DOCUMENT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int32()), ("packed", pa.binary()), ("pair", pa.int64()), ("docs", pa.int64())])


def _encoded(docs: DataFrame, model_a: bytes, model_b: bytes, key: str, text: str) -> DataFrame:
    """A row for each document (pair null), and for each task one row for each of its id pairs: pair, docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model_a, model_b))
    name = zlib.crc32(model_a), zlib.crc32(model_b)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, size = worker_held("aligner", name, lambda: Aligner(*shared.value)), [], 0

        def summed() -> list[tuple[np.ndarray, np.ndarray]]:
            if not held:
                return []
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return [(pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64))]

        for x in batches:
            lengths = pa.compute.utf8_length(x["text"]).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // CHARS, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True):
                if a == b:
                    continue
                ids, texts = x["doc_id"].slice(a, b - a), x["text"].slice(a, b - a).to_pylist()
                sizes, digests, at, pair, times = aligner.align(texts)
                bounds = np.searchsorted(at, np.arange(len(texts) + 1)).tolist()
                packed = [_packed(pair[u:v], times[u:v]) for u, v in zip(bounds, bounds[1:], strict=False)]
                none = pa.nulls(len(texts), pa.int64())
                columns = [ids, *[pa.array(sizes[:, k]) for k in range(4)], pa.array(digests, pa.string()), pa.array(np.diff(bounds), pa.int32()), pa.array(packed, pa.binary()), none, none]
                yield pa.RecordBatch.from_arrays(columns, schema=DOCUMENT)
                if len(pair):
                    held.append(np.unique(pair, return_counts=True))
                    size += len(held[-1][0])
                if size > HELD:
                    held = summed()
                    if len(held[0][0]) > HELD // 2:
                        yield from counted(held)
                        held = []
                    size = sum(len(p) for p, _ in held)
        yield from counted(summed())

    def counted(sums: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for pairs, n in sums:
            for k in range(0, len(pairs), 50_000):
                m = len(pairs[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([*[pa.nulls(m, f.type) for f in list(DOCUMENT)[:8]], pa.array(pairs[k : k + m]), pa.array(n[k : k + m])], schema=DOCUMENT)

    rows = docs.select(column(key).cast("long").alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, packed binary, pair long, docs long")


def _with_counts(rows: DataFrame, pairs: np.ndarray, counts: np.ndarray) -> DataFrame:
    """rows with the part of some id pairs (sorted; all of their A ids) in n_best and count_sum added."""
    ids = pairs >> B_BITS
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    best = counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(ids))))
    shared = rows.sparkSession.sparkContext.broadcast((pairs.astype("<u4"), counts, best))
    schema = rows.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for x in batches:
            n_best, count_sum = [], []
            for packed, n, old_best, old_sum in zip(*[x[c].to_pylist() for c in ("packed", "n_pairs", "n_best", "count_sum")], strict=True):
                pair, times = _unpacked(packed, n)
                at = np.minimum(np.searchsorted(known, pair.astype("<u4")), len(known) - 1)
                times = np.where(known[at] == pair, times, 0)
                n_best.append(old_best + int(times @ best[at]))
                count_sum.append(old_sum + int(times @ counts[at]))
            new = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(f.name, x[f.name]) for f in x.schema], x.schema.names)

    return rows.mapInArrow(of, schema)


def slices(of_id: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of A ids, from and to, with `most` pairs at most (more only for one id alone); of_id: pairs of each A id."""
    out: list[list[int]] = []
    for i in sorted(of_id):
        if not out or out[-1][2] + of_id[i] > most:
            out.append([i, i, 0])
        out[-1][1:] = [i, out[-1][2] + of_id[i]]
    return [(a, b) for a, b, _ in out]


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", most: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. path_a, path_b: the model files, on the driver."""
    encoded = durable(_encoded(docs, read_file(path_a), read_file(path_b), key, text), "encoded")
    counts = durable(encoded.filter("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    zero = F.lit(0).cast("long")
    rows = encoded.filter("pair is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256", "n_pairs", "packed")
    a_id = F.shiftright("pair", B_BITS)
    of_id = {r.a: r.n for r in counts.groupBy(a_id.alias("a")).agg(F.count("*").alias("n")).collect()}  # a row for each id of A at most
    for k, (low, high) in enumerate(slices(of_id, most)):
        part = counts.filter(a_id.between(low, high)).toArrow()
        pairs, n = part["pair"].to_numpy(), part["docs"].to_numpy()
        order = np.argsort(pairs)
        rows = _with_counts(durable(rows, "counted") if k else rows, pairs[order], n[order])
    return rows.drop("n_pairs", "packed")


def byte_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_align(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_path(), piece_path())


QUERIES = {"op11_align": op11_align}
