"""The engine's canonical tables derived from the given Parquet tables.

sources    layer, file, lang, n_bytes, text, hash
endpoints  layer, uuid, n, kind, file, anchor_kind, anchor_name, rel_start, rel_end, target_layer, task_id,
           hash, shape_hash, accepted, accepted_len, state, range_start, range_end, commit
lines      layer, file, line (from 1), start, end, text
commits    layer, file, commit, seq, ts
definitions symbol, file, name_start, name_end, body_start, body_end;  occurrences symbol, file, roles, start, end, doc_seq
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tautline.functions import text as T

ENDPOINT = (
    "layer string, uuid string, n int, kind string, file string, anchor_kind string, anchor_name string, rel_start long, rel_end long, "
    "target_layer string, task_id string, hash string, shape_hash string, accepted string, accepted_len long, state string, range_start long, range_end long, commit string"
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_file() -> Column:
    return F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _source(df: DataFrame, layer: Column, file: Column, text: Column) -> DataFrame:
    f = df.select(layer.alias("layer"), file.alias("file"), text.alias("text"))
    return f.select("layer", "file", T.language(F.col("file")).alias("lang"), F.octet_length("text").cast("long").alias("n_bytes"), "text", T.digest(F.col("text")).alias("hash"))


def doc_sources(spark: SparkSession, d: str, current: bool = True, before: bool = False) -> DataFrame:
    """Documents as files of the root layer; current: without those dropped since their link was accepted; before: as they were before a
    quarter of them changed."""
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" before"))).otherwise(F.col("text")) if before else F.col("text")
    return _source(docs.filter("doc_id % 10 <> 3") if current else docs, F.lit("."), doc_file(), text)


def page_sources(spark: SparkSession, d: str) -> DataFrame:
    return _source(table(spark, d, "pages"), F.lit(".stratum/web"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))


def chat_sources(spark: SparkSession, d: str) -> DataFrame:
    return _source(table(spark, d, "conversations"), T.turn_layer(F.col("turn")), F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".txt")), F.col("text"))


def all_sources(spark: SparkSession, d: str) -> DataFrame:
    return doc_sources(spark, d, current=False).unionByName(page_sources(spark, d)).unionByName(chat_sources(spark, d))


def doc_links(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, s, file, uuid, text, ln, frag, base0, base1: one link of each document, from the whole file to a line of it."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10).alias("s"), doc_file().alias("file"), T.link_id(F.lit("doc"), F.col("doc_id").cast("string")).alias("uuid"), "text")
    docs = docs.withColumn("ln", (1 + F.col("doc_id") % F.size(F.split("text", "\n"))).cast("int"))
    docs = docs.withColumn("frag", F.element_at(F.split("text", "\n"), F.col("ln")))
    changed = lambda c: F.when(F.col("s") == 0, F.lit(None).cast("string")).when(F.col("s") == 1, F.concat(c, F.lit(" 0"))).when(F.col("s") == 2, F.replace(F.col(c), F.lit(" "), F.lit("  ")))
    return docs.withColumn("base0", changed("text").otherwise(F.col("text"))).withColumn("base1", changed("frag").when(F.col("s") == 4, F.substring("frag", 4, 1 << 30)).otherwise(F.col("frag")))


def _endpoints(df: DataFrame, **columns: Column) -> DataFrame:
    names = [x.split() for x in ENDPOINT.split(", ")]
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 12)


def doc_endpoints(spark: SparkSession, d: str) -> DataFrame:
    links = doc_links(spark, d)
    whole = _endpoints(links, layer=F.lit("."), uuid=F.col("uuid"), n=F.lit(0), kind=F.lit("structural"), file=F.col("file"), hash=T.digest(F.col("base0")), accepted=F.col("base0"), accepted_len=F.octet_length("base0"), commit=_short(T.digest(F.col("base0"))))
    name = F.concat(F.when(F.col("s") == 5, "X").otherwise(""), F.lit("L"), F.col("ln").cast("string"))
    line = _endpoints(
        links, layer=F.lit("."), uuid=F.col("uuid"), n=F.lit(1), kind=F.lit("structural"), file=F.col("file"), anchor_kind=F.lit("line"), anchor_name=name,
        hash=T.digest(F.col("base1")), shape_hash=T.digest(T.shape(F.col("base1"))), accepted=F.col("base1"), accepted_len=F.octet_length("base1"), commit=_short(T.digest(F.col("base1"))),
    )
    return whole.unionByName(line)


def chat_pairs(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, uuid, file, up (text), low (text of the next turn), stored (digest that the upper record holds), removed."""
    c = table(spark, d, "conversations")
    low = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("low"))
    p = c.select("conv_id", "turn", F.col("text").alias("up")).join(low, ["conv_id", "turn"])
    stored = F.when(F.col("conv_id") % 4 == 0, F.lit(None).cast("string")).when(F.col("conv_id") % 4 == 1, T.digest(F.concat("low", F.lit(" old")))).otherwise(T.digest(F.col("low")))
    return p.select(
        "conv_id", "turn", T.link_id(F.lit("pair"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid"), F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("file"),
        "up", "low", stored.alias("stored"), (F.col("turn") % 5 == 4).alias("removed"),
    )


def pair_endpoints(spark: SparkSession, d: str) -> DataFrame:
    p = chat_pairs(spark, d)
    upper, lower = T.turn_layer(F.col("turn")), T.turn_layer(F.col("turn") + 1)
    both = p.filter("not removed")
    up, low = T.digest(F.col("up")), T.digest(F.col("low"))
    return (
        _endpoints(p, layer=upper, uuid=F.col("uuid"), n=F.lit(0), kind=F.lit("structural"), file=F.col("file"), hash=up, accepted=F.col("up"), accepted_len=F.octet_length("up"), commit=_short(up))
        .unionByName(_endpoints(p, layer=upper, uuid=F.col("uuid"), n=F.lit(1), kind=F.lit("layer"), target_layer=lower, hash=F.col("stored")))
        .unionByName(_endpoints(both, layer=lower, uuid=F.col("uuid"), n=F.lit(0), kind=F.lit("layer"), target_layer=upper, hash=up))
        .unionByName(_endpoints(both, layer=lower, uuid=F.col("uuid"), n=F.lit(1), kind=F.lit("structural"), file=F.col("file"), hash=low, accepted=F.col("low"), accepted_len=F.octet_length("low"), commit=_short(low)))
    )


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("task_id"), F.concat_ws(":", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("text"))


def task_endpoints(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("doc_id % 10 <> 3").select("doc_id", doc_file().alias("file"), "text")
    t = docs.join(table(spark, d, "labels"), "doc_id").withColumn("task", F.concat_ws(":", F.col("quality").cast("string"), F.col("toxic").cast("string")))
    uuid = T.link_id(F.lit("task"), F.col("doc_id").cast("string"))
    old = F.when(F.col("doc_id") % 6 == 1, F.concat("task", F.lit(" old"))).otherwise(F.col("task"))
    return _endpoints(t, layer=F.lit("."), uuid=uuid, n=F.lit(0), kind=F.lit("structural"), file=F.col("file"), hash=T.digest(F.col("text")), accepted=F.col("text"), accepted_len=F.octet_length("text")).unionByName(
        _endpoints(t, layer=F.lit("."), uuid=uuid, n=F.lit(1), kind=F.lit("task"), task_id=F.col("doc_id").cast("string"), hash=T.digest(old))
    )


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a commit of the file that its user stands for."""
    e = table(spark, d, "events")
    return e.select(F.lit(".").alias("layer"), F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".txt")).alias("file"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 12).alias("commit"), F.col("event_id").alias("seq"), "ts", "event_type", "value")


def link_commits(spark: SparkSession, d: str) -> DataFrame:
    """Two commits of the files of documents and tasks; every fourth document's file has none."""
    docs = table(spark, d, "documents").filter("doc_id % 4 <> 3").select(doc_file().alias("file"))
    done = table(spark, d, "labels").select(F.concat(F.lit(".stratum/worklist/"), F.col("doc_id").cast("string"), F.lit(".task")).alias("file"))
    each = docs.union(done).select(F.lit(".").alias("layer"), "file", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return each.select("layer", "file", _short(T.digest(F.concat_ws(":", "file", F.col("seq").cast("string")))).alias("commit"), "seq")


def doc_commits(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a commit on the file of the document that has its user's number."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("user_id"), doc_file().alias("file"))
    e = table(spark, d, "events").join(files, "user_id")
    return e.select(F.lit(".").alias("layer"), "file", _short(F.sha2(F.col("event_id").cast("string"), 256)).alias("commit"), F.col("event_id").alias("seq"))


def doc_versions(spark: SparkSession, d: str) -> DataFrame:
    """layer, file, commit, seq, text: the file of each document link as it was when its whole-file end was accepted, when its line was, and now."""
    links = doc_links(spark, d)
    lines = F.split("text", "\n")
    line = F.array_join(F.transform(lines, lambda x, i: F.when(i + 1 == F.col("ln"), F.col("base1")).otherwise(x)), "\n")
    seen = lambda seq, mark, text: F.struct(F.lit(seq).cast("long").alias("seq"), _short(T.digest(mark)).alias("commit"), text.alias("text"))
    each = links.select("file", F.explode(F.array(seen(1, F.col("base0"), F.col("base0")), seen(2, F.col("base1"), line), seen(3, F.concat(F.lit("now:"), "file"), F.col("text")))).alias("v"))
    return each.filter("v.commit is not null").select(F.lit(".").alias("layer"), "file", "v.commit", "v.seq", "v.text")


def chat_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's file in its one version."""
    return chat_sources(spark, d).select("layer", "file", _short(F.col("hash")).alias("commit"), F.lit(1).cast("long").alias("seq"), "text")


def part_versions(spark: SparkSession, d: str) -> DataFrame:
    """The Rust files of part_sources() in two versions: in the older one a seventh has another function body, the others blanks at the end."""
    now = part_sources(spark, d).filter("lang = 'rust'")
    k = F.regexp_extract("file", "([0-9]+)", 1).cast("long")
    old = F.when(k % 7 == 1, F.regexp_replace("text", "(// [^\n]*)", "$1 old")).otherwise(F.concat("text", F.lit("  \n")))
    both = lambda seq, text: now.select("layer", "file", F.concat(F.lit("c"), F.lit(str(seq))).alias("commit"), F.lit(seq).cast("long").alias("seq"), text.alias("text"))
    return both(1, old).unionByName(both(2, F.col("text")))


def part_sources(spark: SparkSession, d: str) -> DataFrame:
    """Parts as source files: a Rust module with one function, and a Markdown page with a section in another."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_name", "p_type")
    rust = F.concat(F.lit("pub mod m"), "k", F.lit(" {\n    pub fn p"), "k", F.lit("() {\n        // "), "p_name", F.lit("\n    }\n}\n"))
    page = F.concat(F.lit("# Part "), "k", F.lit("\n"), "p_type", F.lit("\n## Name\n"), "p_name", F.lit("\n# End\n"))
    file = lambda ext: F.concat(F.lit("parts/p"), "k", F.lit(ext))
    return _source(p, F.lit("."), file(".rs"), rust).unionByName(_source(p, F.lit("."), file(".md"), page))


def symbol_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the files that definitions() names: one of 999 bytes for each symbol, what its body says."""
    slot = F.expr("p_partkey div 50")
    p = table(spark, d, "part").select(F.concat(F.lit("src/f"), (F.col("p_partkey") % 50).cast("string"), F.lit(".rs")).alias("file"), slot.alias("slot"), F.rpad(F.concat_ws(" ", "p_name", "p_type"), 999, " ").alias("text"))
    return p.select(F.lit(".").alias("layer"), "file", (F.col("slot") + 1).alias("line"), (F.col("slot") * 1000).alias("start"), (F.col("slot") * 1000 + 999).alias("end"), "text")


def definitions(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("(p_partkey div 50) * 1000")
    return table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/fn().")).alias("symbol"), F.concat(F.lit("src/f"), (F.col("p_partkey") % 50).cast("string"), F.lit(".rs")).alias("file"),
        (start + 10).alias("name_start"), (start + 20).alias("name_end"), start.alias("body_start"), (start + 900).alias("body_end"),
    )


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("(l_orderkey div 50) * 1000 + 100 + l_linenumber * 50")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("/fn().")).alias("symbol"), F.concat(F.lit("src/f"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".rs")).alias("file"),
        F.lit(0).alias("roles"), start.alias("start"), (start + 10).alias("end"),
    )
