"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. A line goes if an earlier one (smaller doc_id, or earlier in the same document), whether
that one stays or not, has a set with a Jaccard similarity of at least SIMILAR; lines without any word are left alone. Steps:

- Words are counted over all documents in a fixed number of hashed buckets; a word's rarity is its bucket's count. The
  table of rarities has one number a bucket and travels as a constant. It decides the order only: the result is the
  same under any order of words.
- A line becomes the sorted array of its words' codes: rarity, then hash. Lines of equal sets fold into the first one.
- Sets of so few words that only an equal set is similar need no more than that fold.
- Prefix filter: the rarest words of each set, so many that similar sets share one of them, are listed by code. Pairs from one list pass the length and the positional filter and a bound from parity
  signatures of 64 bits, of long lines 128.
- First every set is compared with the earliest set of its long lists, which settles most members of large groups of
  near copies at a linear cost; sets that are still undecided then meet all earlier sets of their lists. Words with fewer
  than LED occurrences are left out of the first step: what meets in such a list is bounded without it.
- Each candidate pair is verified on the words of its two lines.

Lists are written once in buckets of their code, sorted by it (the joins then sort what is in order). A word that could fill a bucket (by its count one of LISTS at most) is
dealt by line instead and joined in SALTS parts. Of two similar sets the shorter one has the first common word among even
fewer words than its prefix, its index words; postings of such a frequent word meet only if one is an index word's.

Defined results: a null text counts as empty and stays as it is; a null doc_id stands before all others; rows that share
doc_id and text are one document repeated and come out alike; different texts that share a doc_id follow each other in the
order of their hash; of a very long text every line is looked at, and a very long line is a set like any other; of lines
of one set in one document the first stays; an empty table gives no rows; dedup_lines() keeps extra columns of any name.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable, forget, shared_dir, shuffles_removed
from tautline.llm.keys import carried, few, keyed, turned
from tautline.llm.quality import let

#: The similarity as a fraction, the least different words of a line that is looked at, buckets for counting words.
SIMILAR = (4, 5)
MIN_WORDS = 1
BUCKETS = 1 << 18
HASH_BITS = 55
#: A word with more than one in so many of all words is dealt by line; parts in which such words are joined.
LISTS, SALTS = 1024, 8
#: Occurrences of a word from which its list is compared with its earliest set before all of its sets meet.
LED = 512
#: Sets of more words have a longer signature.
LONG = 96
#: One in so many words, by hash, is compared before all of them are.
PART = 4

#: Postings are narrow: hashes hardly repeat in a file, so no dictionary is tried on them; each task writes one bucket, whose order stays.
PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("sig", "key")}
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

#: What names a line: earlier lines are less in this order.
PLACE = ("key", "turn", "line")


def line_words(line: Column) -> Column:
    has = lambda *parts: [F.contains(line, F.lit(p)) for p in parts]
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (line == "")
    for x in has("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | x
    return F.when(odd, F.array_remove(F.split(line, r"[ \x09-\x0D]+"), "")).otherwise(F.split(line, " "))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _rarity(counts: np.ndarray | float) -> np.ndarray:
    return (1 + np.minimum(4 * np.log2(1 + counts), 120)).astype(np.int64)


def rarities(rows: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket four times the binary logarithm of its words' count, from 1 on; the least value of words that could fill a list."""
    each = rows.select(F.explode(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w")).groupBy(bucket(F.xxhash64("w")).alias("b")).agg(F.count("*").alias("n"))
    counts = np.zeros(BUCKETS)
    for batch in each.toArrow().to_batches():  # BUCKETS rows at most
        counts[batch["b"].to_numpy()] = batch["n"].to_numpy()
    return _rarity(counts), int(_rarity(1 + counts.sum() / LISTS)) + 1


def line_sets(rows: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Of each set: key, turn and line of its first line, n (words; a line without words is a set of its own), prefix (array of
    codes; empty if only equal sets are similar), sig and sig2 (bits: the parity of the words that hash to each; sig2 has half of the
    words of sets of more than LONG words and is 0 for others)."""
    a, b = SIMILAR
    table = F.from_json(F.lit("[" + ",".join(map(str, rarity.tolist())) + "]"), "array<int>")  # folded into a constant

    def code(h: Column) -> Column:
        return F.shiftleft(F.coalesce(F.get(table, bucket(h)), F.lit(0)).cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))  # never null: arrays of longs sort fast

    lines = rows.select("key", "turn", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    sets = lines.select(*PLACE, F.sort_array(F.array_distinct(F.transform(F.transform(line_words(F.col("t")), lambda w: F.xxhash64(w)), code))).alias("c"))
    n = F.size("c")
    alone, short = (b - a) * n < a, n < MIN_WORDS
    prefix = F.slice("c", 1, n - F.floor((a * n + b - 1) / b).cast("int") + 1)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    zero = F.lit(0).cast("long")
    sig = F.aggregate("c", zero, lambda acc, x: acc.bitwiseXOR(bit(x)))
    half = F.aggregate("c", zero, lambda acc, x: F.when(x.bitwiseAND(F.lit(64)) == 0, acc).otherwise(acc.bitwiseXOR(bit(x))))
    sets = sets.select(
        *PLACE, n.alias("n"), F.when(short, F.col("key")).otherwise(F.xxhash64("c")).alias("set1"), F.when(short, F.hash("turn", "line")).otherwise(F.hash("c")).alias("set2"),
        F.when(alone, F.array().cast("array<long>")).otherwise(prefix).alias("prefix"), F.when(alone, zero).otherwise(sig).alias("sig"), F.when(n > LONG, half).otherwise(zero).alias("sig2"),
    )
    return sets.groupBy("set1", "set2", "n").agg(F.min(F.struct(*PLACE, "prefix", "sig", "sig2")).alias("first")).select("n", "first.*")


def postings(sets: DataFrame, common: int) -> tuple[str, str]:
    """One row for each word of each prefix, and one for each set without prefix: `deal` (of its bucket), code, key, turn, line,
    n, sig, sig2, pos. deal is the code itself and code null, but words of rarity `common` or more are dealt by line, and a
    set without prefix has the code -1. Returns the table's name and path."""
    spark = sets.sparkSession
    rows = sets.select(*PLACE, "n", "sig", "sig2", F.posexplode_outer("prefix").alias("pos", "c"))
    by_line = F.xxhash64(*PLACE)
    frequent = F.col("c") >= F.lit(common << HASH_BITS)
    rows = rows.select(
        F.when(F.col("c").isNull() | frequent, by_line).otherwise(F.col("c")).alias("deal"), F.when(F.col("c").isNull(), F.lit(-1).cast("long")).when(frequent, F.col("c")).alias("code"),
        *PLACE, "n", "sig", "sig2", F.coalesce("pos", F.lit(0)).alias("pos"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"postings_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(WRITERS, "0")
    spark.conf.set(WRITERS, "1")  # or Spark sorts by the bucket's number first
    try:
        with shuffles_removed(spark):
            rows.repartition(parts, "deal").sortWithinPartitions("deal").write.options(**PLAIN).bucketBy(parts, "deal").option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(WRITERS, before)
    return name, path


def _earlier(y: str, x: str) -> Column:
    """PLACE of y before that of x, compared column by column: structs would be built for each pair."""
    out = F.lit(False)
    for c in reversed(PLACE):
        a, b = F.col(f"{y}.{c}"), F.col(f"{x}.{c}")
        out = (a < b) | ((a == b) & out)
    return out


def _near(x: str, y: str) -> Column:
    """Length and positional filter for two sets that share a word at the places x.pos and y.pos, and the signatures' bound: sets
    that are similar differ in few words, and each of these turns one bit."""
    a, b = SIMILAR
    n, m, p, q = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    all_bits, half_bits = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("sig", "sig2"))
    halves = F.bit_count(all_bits.bitwiseXOR(half_bits)) + F.bit_count(half_bits)
    apart = F.when((n > LONG) & (m > LONG), halves).otherwise(F.bit_count(all_bits))
    return (b * n >= a * m) & (b * m >= a * n) & ((a + b) * F.least(n - p, m - q) >= a * (n + m)) & ((a + b) * apart <= (b - a) * (n + m))


def _index_word() -> Column:
    """Whether a posting is one of those that hold the first common word wherever its set is the shorter of two similar ones."""
    a, b = SIMILAR
    return (a + b) * F.col("pos") <= (b - a) * F.col("n")


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(*[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "xy" for c in PLACE]).distinct()


def _alike(pairs: DataFrame, lines: DataFrame, words: str) -> DataFrame:
    """Those pairs whose sets of the words' hashes, or of a part of these, differ in no more words than similar sets of n and m words do."""
    a, b = SIMILAR
    both = pairs
    for s in "xy":
        both = both.join(lines.select(*[F.col(c).alias(s + c) for c in PLACE], F.col("n").alias(s + "n"), F.col(words).alias(s)), [s + c for c in PLACE])
    apart = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    return both.filter((a + b) * apart <= (b - a) * (F.col("xn") + F.col("yn"))).select(*pairs.columns)


def verified(pairs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """key, turn and line of the later lines of those pairs whose words have the similarity. Words of every PART-th hash are
    compared first: where these alone differ by too many, the pair goes. A line is cut and hashed once, however many pairs it is in."""
    side = lambda s: pairs.select(*[F.col(s + c).alias(c) for c in PLACE])
    wanted = durable(side("x").union(side("y")).groupBy("key", "turn").agg(F.collect_set("line").alias("wanted")), "wanted")
    texts = rows.join(few(wanted), ["key", "turn"]).select("key", "turn", "wanted", F.split("text", "\n").alias("lines"))
    lines = texts.select("key", "turn", F.explode(F.transform("wanted", lambda i: F.struct(i.alias("line"), F.get("lines", i).alias("t")))).alias("l")).select("key", "turn", "l.*")
    lines = lines.withColumn("c", F.array_distinct(F.transform(line_words(F.col("t")), lambda w: F.xxhash64(w))))
    lines = durable(lines.select(*PLACE, "c", F.size("c").alias("n"), F.filter("c", lambda h: h.bitwiseAND(F.lit(PART - 1)) == 0).alias("some")), "lines")
    likely = durable(_alike(pairs, lines, "some"), "likely")
    return durable(_alike(likely, lines, "c").select(*[F.col("x" + c).alias(c) for c in PLACE]).distinct(), name)


def _with_leaders(posted: DataFrame, by: str, broadcast: bool = False) -> DataFrame:
    """x, y: postings with the earliest posting of their list, where that is another one."""
    leaders = posted.groupBy(by).agg(F.min(F.struct(*PLACE, "n", "pos", "sig", "sig2")).alias("y"), F.count("*").alias("members")).filter("members > 1").select(by, "y")
    return posted.alias("x").join(F.broadcast(leaders) if broadcast else leaders, by).filter(_earlier("y", "x") & _near("x", "y"))


def _meeting(undecided: DataFrame, posted: DataFrame, by: list[str]) -> DataFrame:
    """The pairs x, y of undecided sets with all earlier ones of their lists."""
    return _pairs(undecided.alias("x").join(posted.alias("y"), [*[F.col(f"x.{c}") == F.col(f"y.{c}") for c in by], _earlier("y", "x"), _near("x", "y")]))


def later_lines(posted: DataFrame, rows: DataFrame) -> DataFrame:
    """key, turn and line of the first lines of those sets that have a similar earlier set."""
    dealt, frequent = posted.filter("code is null"), posted.filter("code >= 0").drop("deal")
    long = dealt.filter(F.col("deal") >= F.lit(int(_rarity(LED)) << HASH_BITS))
    led = _pairs(_with_leaders(long, "deal")).union(_pairs(_with_leaders(frequent, "code", broadcast=True)))  # LISTS frequent words at most
    one = verified(durable(led.distinct(), "led"), rows, "settled")
    settled = few(one)
    undecided = lambda df: df.join(settled, list(PLACE), "left_anti")
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one_salt = undecided(frequent).withColumn("salt", F.pmod(F.xxhash64(*PLACE), F.lit(SALTS)).cast("int"))
    index = _index_word()
    met = _meeting(undecided(dealt), dealt, ["deal"])
    met = met.union(_meeting(one_salt, salted.filter(index), ["code", "salt"])).union(_meeting(one_salt.filter(index), salted.filter(~index), ["code", "salt"]))
    return one.union(verified(durable(met.distinct(), "met"), rows, "met-later"))


def kept_lines(rows: DataFrame) -> DataFrame:
    """rows: key, turn (which name a row), text. key, turn and the sorted list `stay` of the lines that stay: the first of their set, without a similar earlier one."""
    spark = rows.sparkSession
    rarity, common = rarities(rows)
    name, path = postings(line_sets(rows, rarity), common)
    posted = spark.table(name)
    later = later_lines(posted, rows)
    stay = posted.filter("pos = 0").select(*PLACE).join(few(later), list(PLACE), "left_anti")
    out = durable(stay.groupBy("key", "turn").agg(F.sort_array(F.collect_list("line")).alias("stay")), "kept")
    spark.sql(f"DROP TABLE {name}")
    forget(spark, path)
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed lines cut from their text; other columns and the number of rows stay."""
    rows, once = turned(carried(docs, key, text))
    stay = F.coalesce("stay", F.array().cast("array<int>"))
    cut = let(F.split(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), "\n"), lambda x: F.array_join(F.transform(stay, lambda i: x[i]), "\n"))
    kept = kept_lines(once).hint("shuffle_hash")  # lists are far smaller than texts: hashed, so that texts aren't sorted; the same plan at every size
    out = rows.select("row", "key", "turn").join(kept, ["key", "turn"], "left").withColumn("cut", cut)
    return out.select(*[(F.when(F.col(f"row.`{c}`").isNotNull(), F.col("cut")) if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_lines(spark, sf_dir: str) -> DataFrame:
    """n_lines, n_removed and the numbers (from 0) of the removed lines of each document."""
    rows, once = turned(keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    n = rows.select("doc_id", "key", "turn", (1 + F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("n"))
    out = n.join(kept_lines(once), ["key", "turn"], "left").withColumn("stay", F.coalesce("stay", F.array().cast("array<int>")))
    gone = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("stay"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


QUERIES = {"op7_lines": op7_lines}
