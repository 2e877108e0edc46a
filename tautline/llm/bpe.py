"""BPE encoding and decoding with a public vocabulary, by batched numpy merge rounds.

The words of many texts go into one flat array of symbols. In each round the ranks of all neighbouring pairs are found
by binary search over the sorted pair keys, each word's lowest-ranked pair is merged wherever it stands, and words
without a known pair leave. The vocabulary file is read once on the driver; its arrays have a fixed size and are
broadcast. Executors keep what they have encoded by word, up to WORDS words. Which characters are letters or numbers and
how they are lowered follows the tokenizers library: its tables are compared once with those of this Python, and texts
that hold a character in which they differ are split by the library's tables.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; a null doc_id and
repeated rows pass through; the two special tokens are recognised in a text, as the tokenizers library does; equal ranks
are merged from the left; very long texts and words are encoded whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tautline.llm.keys import column

#: Words that an executor remembers, and characters of text that it splits at once.
WORDS, CHARS = 300_000, 2_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What the merge rounds need of a vocabulary file."""

    keys: np.ndarray  # sorted: left id << 32 | right id
    ranks: np.ndarray  # of the keys
    merged: np.ndarray  # id by rank
    first: np.ndarray  # id of each byte
    last: np.ndarray  # id of each byte at a word's end
    tokens: list[str]
    specials: dict[str, int]
    pattern: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        model = d["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        at = byte_symbols()
        first, last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in at.items():
            first[b], last[b] = ids[c], ids[c + end]
        specials = {x["content"]: x["id"] for x in d["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *specials.values()]) + 1)
        for t, i in [*ids.items(), *specials.items()]:
            tokens[i] = t
        pattern = next(p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return Vocabulary(keys[order], order, np.array([ids[a + b] for a, b in pairs], np.int64), first, last, tokens, specials, pattern)


def merge_words(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The ids of each word (at least one byte each)."""
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths) - 1
    symbols = v.first[raw]
    symbols[ends] = v.last[raw[ends]]
    owner = np.repeat(np.arange(len(words)), lengths)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)

    def settle(s: np.ndarray, o: np.ndarray) -> None:
        if len(o):
            cuts = np.flatnonzero(np.diff(o)) + 1
            for w, part in zip(o[np.concatenate(([0], cuts))].tolist(), np.split(s, cuts), strict=True):
                out[w] = part

    none = len(v.ranks)
    while len(symbols):
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, key), none - 1)
        rank = np.where((v.keys[at] == key) & (owner[:-1] == owner[1:]), v.ranks[at], none)
        rank = np.append(rank, none)  # of the pair that begins at each symbol
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(symbols)))
        least = np.repeat(least, size)
        done = least == none
        if done.any():
            settle(symbols[done], owner[done])
            symbols, owner, rank, least = symbols[~done], owner[~done], rank[~done], least[~done]
            if not len(symbols):
                break
        hit = rank == least
        if (hit[1:] & hit[:-1]).any():  # equal symbols in a row: every other one begins a pair
            where = np.arange(len(hit))
            began = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), where, 0))
            hit &= (where - began) % 2 == 0
        symbols = np.where(hit, v.merged[np.minimum(least, none - 1)], symbols)
        keep = ~np.append(False, hit[:-1])
        symbols, owner = symbols[keep], owner[keep]
    return out


@dataclass
class Characters:
    """Where the tokenizers library sees characters otherwise than this Python does."""

    classes: dict[str, str]  # ranges of the library's letters (\\p{L}) and numbers (\\p{N}), to stand in brackets
    lower: dict[str, str]  # lower case of characters that Python lowers otherwise
    odd: str  # ranges of the characters that differ in one of these


def _ranges(codes: np.ndarray) -> str:
    """Sorted code points as ranges that may stand in brackets."""
    cuts = np.flatnonzero(np.diff(codes) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[np.append(0, cuts + 1)].tolist(), codes[np.append(cuts, len(codes) - 1)].tolist(), strict=True)) if len(codes) else ""


@cache
def library_characters() -> Characters:
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 10]
    text = "".join(every)
    odd: set[str] = set()
    classes = {}
    for name in (r"\p{L}", r"\p{N}"):
        theirs = "".join(x for x, _ in pre_tokenizers.Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str(text))
        odd |= set(theirs) ^ set(regex.findall(name, text))
        classes[name] = _ranges(np.array(sorted(map(ord, theirs))))
    lowered = normalizers.Lowercase().normalize_str("\n".join(every)).split("\n")
    lower = {c: x for c, x in zip(every, lowered, strict=True) if x != c.replace("Σ", "σ").lower()}
    return Characters(classes, lower, _ranges(np.array(sorted(map(ord, odd | set(lower))))))


def normalize(text: str, lower: dict[str, str] | None = None) -> str:
    """NFC, then lower case character by character (a final sigma is not special); lower: characters with another lower case."""
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return "".join([lower.get(c) or c.lower() for c in text]) if lower else text.lower()


def _pinned(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with the ranges in place of the classes' names, which it has in brackets or not."""
    out, inside, k = "", False, 0
    while k < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, k)), None)
        if name:
            out += classes[name] if inside else f"[{classes[name]}]"
        elif pattern[k] == "\\":
            name = pattern[k : k + 2]
            out += name
        else:
            name = pattern[k]
            inside = name == "[" or inside and name != "]"
            out += name
        k += len(name)
    return out


class Encoder:
    """Encodes texts, remembering words."""

    def __init__(self, v: Vocabulary, characters: Characters | None = None):
        self.v = v
        self.find = regex.compile(v.pattern).findall
        self.characters = characters or library_characters()
        self.odd = re.compile(f"[{self.characters.odd}]").search if self.characters.odd else lambda text: None
        self.find_pinned = regex.compile(_pinned(v.pattern, self.characters.classes)).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, v.specials)) + ")") if v.specials else None
        self.seen: dict[str, tuple[bytes, str]] = {}
        self.fixed = {t: (np.array([i], "<u4").tobytes(), v.tokens[i]) for t, i in v.specials.items()}

    def words(self, text: str) -> list[str]:
        if text.isascii() or not self.odd(text):
            return self.find(normalize(text))
        return self.find_pinned(normalize(text, self.characters.lower))

    def split(self, text: str) -> list[str]:
        if self.specials is None or not any(t in text for t in self.v.specials):
            return self.words(text)
        return [w for k, part in enumerate(self.specials.split(text)) for w in ([part] if k % 2 else self.words(part))]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.seen and w not in self.fixed]
        if len(self.seen) + len(new) > WORDS:
            self.seen.clear()
            new = [w for w in words if w not in self.fixed]
        tokens = self.v.tokens
        if new:
            for w, ids in zip(new, merge_words([w.encode("utf-8", "surrogatepass") for w in new], self.v), strict=True):
                self.seen[w] = ids.astype("<u4").tobytes(), " ".join([tokens[i] for i in ids.tolist()])

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the text that these decode to."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        ids, decoded = [], []
        for words in split:
            got = [self.fixed.get(w) or self.seen[w] for w in words] if any(t in words for t in self.fixed) else [self.seen[w] for w in words]
            ids.append(b"".join([x[0] for x in got]))
            decoded.append(" ".join([x[1] for x in got]))
        return ids, decoded


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), decoded. path: the vocabulary file, on the driver."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vars(Vocabulary.load(path)), vars(library_characters())))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Vocabulary(**shared.value[0]), Characters(**shared.value[1]))
        for x in batches:
            upto = np.cumsum([len(t) for t in x["text"]]) // CHARS
            for _, part in x.groupby(upto, sort=False):
                ids, decoded = encoder.encode(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids, "decoded": decoded})

    rows = docs.select(column(key).cast("long").alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    out = rows.mapInPandas(of, "doc_id long, ids binary, decoded string")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_bpe": op9_bpe}
