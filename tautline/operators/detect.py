"""Refinements of drift: moved, reanchored, expanded and deleted content, sources of changes, fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.functions.durable import durable
from tautline.operators.asof import as_of
from tautline.operators.check import KEY
from tautline.operators.fragments import anchor_resolve, declarations, fragment_get, line_offsets, named_fragments, subrange_slice
from tautline.operators.symbols import declaration_by_name


def prune_unchanged(endpoints: DataFrame, commits: DataFrame) -> DataFrame:
    """The endpoints (layer, uuid, n, kind, file, accepted_seq, any others) to check again: structural ones whose file a commit (layer, file, seq) after
    the accepted one touches, or whose accepted commit is unknown; and all tasks. check.recheck() does so."""
    last = commits.groupBy("layer", "file").agg(F.max("seq").alias("last"))
    known = endpoints.filter("kind = 'structural' and accepted_seq is not null").join(last, ["layer", "file"]).filter("last > accepted_seq")
    unknown = endpoints.filter("kind = 'task' or (kind = 'structural' and accepted_seq is null)")
    return known.select(*endpoints.columns).unionByName(unknown)


def detect_moved(missing: DataFrame, sources: DataFrame) -> DataFrame:
    """missing (uuid, n, hash) whose content stands in another file now: new_file (the smallest), candidates."""
    by_hash = sources.groupBy("hash").agg(F.min("file").alias("new_file"), F.count("*").alias("candidates"))
    return missing.join(by_hash, "hash").select("uuid", "n", "new_file", "candidates")


def detect_moved_similar(missing: DataFrame, added: DataFrame, threshold: float = 0.5) -> DataFrame:
    """missing (uuid, text), added (file, text): for each missing one the added file with the most similar set of lines (Jaccard) from the threshold
    on. Equal sets fold into one first. Of the added files only lines that a missing one has are looked at further. A missing set's lines are ordered by how
    many added sets have them; an added set that is similar has one of so many of its rarest lines that they meet by these alone, so that a line which many
    files have makes no pairs. Pairs whose sizes allow it are compared on their whole sets."""
    least = threshold - 1e-6  # similarities are rounded
    lines = F.array_sort(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x))))

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name).alias("name"), lines.alias("ls")).withColumn("sid", F.struct(F.xxhash64("ls").alias("a"), F.hash("ls").alias("b")))

    def sets(df: DataFrame, name: str, s: str) -> DataFrame:
        folded = named(df, name).groupBy("sid").agg(F.min("name").alias("name"), F.first("ls").alias("ls"))
        return durable(folded.select(F.col("sid").alias(s), F.col("name").alias(f"name{s}"), F.col("ls").alias(f"l{s}"), F.size("ls").alias(f"n{s}")), f"line-sets-{s}")

    x, y = sets(missing, "uuid", "x"), sets(added, "file", "y")
    asked = x.select("x", "nx", F.explode("lx").alias("h"))
    there = durable(y.select("y", "ny", F.explode("ly").alias("h")).join(asked.select("h").distinct(), "h", "left_semi"), "shared-lines")
    held = there.groupBy("h").agg(F.count("*").alias("sets"))
    order = Window.partitionBy("x").orderBy(F.coalesce("sets", F.lit(0)), "h")
    prefix = asked.join(held, "h", "left").withColumn("pos", F.row_number().over(order) - 1).filter(F.col("sets").isNotNull() & (F.col("pos") <= F.col("nx") - F.ceil(least * F.col("nx"))))
    met = prefix.select("x", "nx", "h").join(there, "h").filter((F.col("nx") >= least * F.col("ny")) & (F.col("ny") >= least * F.col("nx"))).select("x", "y").distinct()
    both = met.join(x.drop("namex"), "x").join(y, "y").withColumn("common", F.size(F.array_intersect("lx", "ly")))
    j = F.round(F.col("common") / (F.col("nx") + F.col("ny") - F.col("common")), 6)
    best = both.select("x", "namey", j.alias("similarity")).filter(F.col("similarity") >= threshold).groupBy("x").agg(F.min_by(F.struct(F.col("namey").alias("file"), "similarity"), F.struct(-F.col("similarity"), F.col("namey"))).alias("b"))
    members = named(missing, "uuid").select(F.col("name").alias("uuid"), F.col("sid").alias("x"))
    return members.join(best, "x").select("uuid", F.col("b.file").alias("new_file"), F.col("b.similarity").alias("similarity"))


def detect_reanchored(unanchored: DataFrame, fragments: DataFrame) -> DataFrame:
    """unanchored (uuid, n, layer, file, anchor_kind, anchor_name, hash) whose content stands under another anchor: new_name (the first)."""
    f = fragments.select("layer", "file", F.col("kind").alias("anchor_kind"), "name", "start", T.digest(F.col("text")).alias("hash"))
    hit = unanchored.join(f, ["layer", "file", "anchor_kind", "hash"]).filter("name <> anchor_name")
    return hit.groupBy("uuid", "n").agg(F.min_by("name", "start").alias("new_name"))


def detect_expanded(altered: DataFrame) -> DataFrame:
    """altered (uuid, n, accepted, node_text): EXPANDED where the anchor still holds the accepted text with its shape, that is, no word or number of it has
    grown together with what stands around it; else ALTERED."""
    at = F.position(F.col("accepted"), F.col("node_text"))
    held = F.col("accepted").isNotNull() & (F.col("accepted") != "") & (at > 0)
    around = [F.left("node_text", at - 1), F.substring("node_text", at + F.length("accepted"), F.length("node_text"))]
    same = F.concat(T.shape(around[0]), T.shape(F.col("accepted")), T.shape(around[1])) == T.shape(F.col("node_text"))
    return altered.select("uuid", "n", F.when(held & same, "EXPANDED").otherwise("ALTERED").alias("state"))


def _trimmed(text: str) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def fragment_diff(endpoints: DataFrame, versions: DataFrame, sources: DataFrame, kinds: tuple[str, ...] = ("line",), commits: DataFrame | None = None) -> DataFrame:
    """layer, uuid, n, file, commit, changed, first_line, last_line: what each end was when it was accepted against what it is now (white space at the end
    doesn't count), the lines it stands on now and the commit it was accepted at.

    versions (layer, file, commit, seq, text): the file's text then is that of its last version up to the accepted commit; its anchor is looked up
    there and, by the same name, in `sources`. kinds: those of anchors that ends name. commits (layer, commit, seq): for accepted commits that don't touch the
    file themselves; without it they are looked up among the file's versions. A layer end shows the structural side (side 0 first) of the record
    it points to. Ends without a known commit, a file, or an anchor on both sides are left out. Whole files are compared by digests worked out where their texts
    are; only texts in which an anchor is looked up are shuffled."""
    ready = endpoints.filter("kind = 'structural' and commit is not null").select(*KEY, "kind", "file", "anchor_kind", "anchor_name", "rel_start", "rel_end", "commit")
    by = ["layer", "file", "commit"] if commits is None else ["layer", "commit"]
    seqs = (versions if commits is None else commits).groupBy(*by).agg(F.max("seq").alias("accepted_seq"))
    then = as_of(ready.join(seqs, by), versions.select("layer", "file", "seq"), ["layer", "file"], "accepted_seq", "seq", ["seq"])
    held = versions.groupBy("layer", "file", "seq").agg(F.max("commit").alias("held"))  # of versions with one number the greatest commit's counts
    then = then.filter("seq is not null").join(held, ["layer", "file", "seq"])
    then = durable(then.withColumn("now", F.col("file")).withColumn("file", F.concat_ws("@", "file", F.col("seq").cast("string"), "held")).drop("held"), "ends-then")
    at = F.concat_ws("@", "file", F.col("seq").cast("string"), "commit")
    old = versions.select("layer", at.alias("file"), T.language(F.col("file")).alias("lang"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    rows = [*KEY, "file", "commit"]
    whole, named = then.filter("anchor_name is null"), then.filter("anchor_name is not null")
    was = old.select("layer", "file", T.digest(_trimmed("text")).alias("was")).groupBy("layer", "file").agg(F.max("was").alias("was"))
    was = whole.join(was, ["layer", "file"]).select(*KEY, F.col("now").alias("file"), "commit", "was")
    now = was.join(sources.select("layer", "file", T.digest(_trimmed("text")).alias("is"), F.size(F.split("text", "\n")).alias("last_line")), ["layer", "file"])
    own = now.select(*rows, (F.col("was") != F.col("is")).alias("changed"), F.lit(1).alias("first_line"), "last_line")
    part = subrange_slice(anchor_resolve(named, named_fragments(old, kinds))).filter("node_start is not null").select(*KEY, F.col("frag").alias("was"))
    here = named.withColumn("file", F.col("now")).drop("now", "seq", "accepted_seq")
    here = subrange_slice(anchor_resolve(here, named_fragments(sources, kinds))).filter("node_start is not null").select(*rows, F.col("frag").alias("is"), F.col("frag_start").alias("start"), F.col("frag_end").alias("end"))
    both = durable(here.join(part, KEY).select(*rows, (_trimmed("was") != _trimmed("is")).alias("changed"), "start", "end", F.concat_ws("@", "uuid", "layer", F.col("n").cast("string")).alias("id")), "ends-both")
    on = fragment_get(both.select("layer", "file", "id", "start", "end"), line_offsets(sources)).select("id", "first_line", "last_line")
    own = durable(own.unionByName(both.drop("start", "end").join(on, "id").drop("id")), "ends-changed")
    sides = endpoints.filter("kind = 'structural'").groupBy("layer", "uuid").agg(F.min("n").alias("n"))
    there = own.join(sides, KEY).drop("n").withColumnRenamed("layer", "target_layer")
    hop = endpoints.filter("kind = 'layer'").select(*KEY, "target_layer").join(there, ["target_layer", "uuid"]).drop("target_layer")
    return own.unionByName(hop)


def callee_diff(callees: DataFrame, versions: DataFrame, sources: DataFrame, kinds: list[str], root: str = ".") -> DataFrame:
    """callees (symbol, layer, file, name, accepted_seq) -> symbol, state: OK where the declaration of that name in the file's last version up to accepted_seq
    has the text of the one in `sources` (white space at the end doesn't count), ALTERED where it hasn't or there was none. kinds: of declarations, tried in order. Files outside
    the layer `root` and symbols without a declaration now are left out."""
    under = F.lit(True) if root == "." else (F.col("layer") == root) | F.col("layer").startswith(root + "/")
    asked = durable(callees.filter(under), "callees-asked")
    then = durable(as_of(asked, versions.select("layer", "file", "seq"), ["layer", "file"], "accepted_seq", "seq", ["seq"]), "callees-then")  # read six times
    old = versions.join(then.select("layer", "file", "seq").distinct().hint("merge"), ["layer", "file", "seq"], "left_semi")
    key = F.concat_ws("@", "layer", "file", F.col("seq").cast("string"))
    columns = ["layer", F.col("file"), T.language(F.col("path")).alias("lang"), F.octet_length("text").cast("long").alias("n_bytes"), "text"]
    old = old.withColumn("path", F.col("file")).withColumn("file", key).select(*columns)
    new = sources.join(asked.select("layer", "file").distinct().hint("merge"), ["layer", "file"], "left_semi").withColumn("path", F.col("file")).withColumn("file", F.concat_ws("@", "layer", "file")).select(*columns)

    def texts(rows: DataFrame, names: DataFrame, text: str) -> DataFrame:
        found = durable(declarations(rows).select("file", "kind", "name", "start", "end", "text"), "declarations")
        first = declaration_by_name(names.distinct(), found.select("file", "kind", "name", "start", "end"), kinds)
        return first.join(found.filter(F.col("kind").isin(kinds)).drop("kind").distinct().hint("merge"), ["file", "name", "start", "end"]).select("file", "name", F.col("text").alias(text))

    then = then.select("symbol", "name", F.concat_ws("@", "layer", "file").alias("new_file"), key.alias("old_file"))
    now = texts(new, then.select(F.col("new_file").alias("file"), "name"), "is").withColumnRenamed("file", "new_file")
    was = texts(old, then.select(F.col("old_file").alias("file"), "name"), "was").withColumnRenamed("file", "old_file")
    both = then.join(now.hint("merge"), ["new_file", "name"]).join(was.hint("merge"), ["old_file", "name"], "left")
    return both.select("symbol", F.when(_trimmed("was") == _trimmed("is"), "OK").otherwise("ALTERED").alias("state"))


def detect_deleted(missing: DataFrame, sources: DataFrame, versions: DataFrame) -> DataFrame:
    """missing (uuid, n, hash): DELETED with the last commit that holds the content if none does now, BROKEN if none ever did."""
    gone = missing.join(sources.select("hash").distinct(), "hash", "left_anti")
    last = versions.groupBy("hash").agg(F.max_by("commit", "seq").alias("commit"))
    return gone.join(last, "hash", "left").select("uuid", "n", F.when(F.col("commit").isNull(), "BROKEN").otherwise("DELETED").alias("state"), "commit")


def change_source(checked: DataFrame, commits: DataFrame) -> DataFrame:
    """checked (layer, uuid, n, file, state, accepted_seq) that aren't OK, with the first commit (layer, file, commit, seq) on their file after the accepted one, or
    UNCOMMITTED; of an unknown accepted commit, nothing is known."""
    bad = checked.filter("state <> 'OK' and file is not null").select(*KEY, "file", "state", "accepted_seq")
    found = as_of(bad, commits.select("layer", "file", "seq", "commit"), ["layer", "file"], "accepted_seq", "seq", ["commit"], after=True)
    return found.select(*KEY, "file", "state", F.when(F.col("accepted_seq").isNotNull(), F.coalesce("commit", F.lit("UNCOMMITTED"))).alias("source"))


def latest_commit(commits: DataFrame) -> DataFrame:
    return commits.groupBy("layer", "file").agg(F.max_by("commit", "seq").alias("commit"))


def file_at_version(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """requests (file, accepted_seq) with the version (file, commit, seq, value) that held then: the last one not after it. Requests without one are left out."""
    held = as_of(requests.select("file", "accepted_seq"), versions, ["file"], "accepted_seq", "seq", ["commit", "value"])
    return held.filter("commit is not null")


def line_delta(pairs: DataFrame) -> DataFrame:
    """pairs (id, before, after) -> id, sign, hash, k: the k-th occurrence of a line that only one side has."""
    def counted(c: str) -> DataFrame:
        return pairs.select("id", F.explode(F.split(c, "\n")).alias("t")).groupBy("id", T.digest(F.col("t")).alias("hash")).agg(F.count("*").alias(c))

    both = counted("before").join(counted("after"), ["id", "hash"], "full_outer").select("id", "hash", F.coalesce("before", F.lit(0)).alias("b"), F.coalesce("after", F.lit(0)).alias("a")).filter("a <> b")
    k = F.explode(F.sequence(F.least("a", "b") + 1, F.greatest("a", "b")))
    return both.select("id", "hash", F.when(F.col("a") > F.col("b"), "+").otherwise("-").alias("sign"), k.alias("k"))
