"""Drift: comparing current fragments with accepted ones and classing each end of a link."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.functions.durable import durable
from tautline.operators.fragments import anchor_resolve, subrange_slice

#: States that need no attention; states from best to worst with their rank.
CLEAN = ("OK", "MOVED", "DISPLACED", "REANCHORED", "EXPANDED", "TODO", "RESTYLED")
RANK = {"NONE": 1, "OK": 2, "MOVED": 3, "DISPLACED": 3, "REANCHORED": 3, "EXPANDED": 3, "RESTYLED": 3, "CHAIN_DIRTY": 4, "PENDING": 5, "TODO": 5, "ALTERED": 6, "UNANCHORED": 7, "DELETED": 8, "BROKEN": 9}
KEY = ["layer", "uuid", "n"]
#: Bytes at which a piece of an anchor begins anew, and digests that are looked for together.
PIECE, DIGESTS = 1024, 64


def rank(state: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.coalesce(state, F.lit("NONE"))], F.lit(1))


def _compare(stored: Column, current: Column) -> Column:
    return F.when(stored.isNull(), "PENDING").when(stored == current, "OK")


def check_whole_file(endpoints: DataFrame, sources: DataFrame) -> DataFrame:
    """layer, uuid, n, state, range_start, range_end of structural endpoints that name no anchor."""
    whole = endpoints.filter("kind = 'structural' and anchor_name is null").select(*KEY, "file", "hash")
    out = whole.join(sources.select("layer", "file", F.col("hash").alias("now"), "n_bytes"), ["layer", "file"], "left")
    state = F.when(F.col("now").isNull(), "BROKEN").when(F.col("hash").isNull(), "PENDING").when(F.col("hash") == F.col("now"), "OK").otherwise("ALTERED")
    return out.select(*KEY, state.alias("state"), F.when(F.col("now").isNotNull(), F.lit(0).cast("long")).alias("range_start"), F.col("n_bytes").alias("range_end"))


def find_displaced(resolved: DataFrame) -> DataFrame:
    """Rows of subrange_slice() with a window of the accepted length in their anchor that has the accepted digest, with new_start, new_end (the first
    place). Only the digest and the length of what was accepted are read, not its text.

    Links to one anchor with one length are looked for together, DIGESTS at a time, so that its windows are hashed once for all of them.
    Anchors are cut into pieces that overlap by a window less one byte and are dealt out, so that a long anchor is the work of many tasks."""
    anchor = ["layer", "file", "anchor_kind", "anchor_name", "node_start", "accepted_len"]
    size = F.octet_length("node_text").cast("long")
    wanted = resolved.filter(F.col("hash").isNotNull() & (F.col("accepted_len") > 0) & (F.col("accepted_len") <= size))
    digests = wanted.select(*anchor, "hash").distinct()
    turn = F.row_number().over(Window.partitionBy(*anchor).orderBy("hash")) - 1
    asked = digests.withColumn("turn", F.floor(turn / DIGESTS)).groupBy(*anchor, "turn").agg(F.collect_list("hash").alias("digests"))
    nodes = wanted.groupBy(*anchor).agg(F.first("node_text").alias("node_text"))
    step, long_ = F.greatest(F.lit(PIECE).cast("long"), "accepted_len"), F.col("accepted_len")
    node = F.encode("node_text", "UTF-8")
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.octet_length("node_text") - long_, step), lambda i: F.struct(i.alias("at"), F.substring(node, (i + 1).cast("int"), (step + long_ - 1).cast("int")).alias("bytes")))
    pieces = nodes.select(*anchor, F.explode(cut).alias("p")).select(*anchor, "p.at", "p.bytes").repartition(F.xxhash64(*anchor, "at"))
    pieces = pieces.join(asked.drop("turn"), anchor)
    window = lambda j: F.sha2(F.substring(F.col("bytes"), (j + 1).cast("int"), long_.cast("int")), 256)
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.octet_length("bytes") - long_), lambda j: F.struct(window(j).alias("hash"), j.alias("j")))
    hits = F.filter(places, lambda x: F.array_contains("digests", x["hash"]))
    found = pieces.select(*anchor, "at", F.explode(hits).alias("x")).groupBy(*anchor, F.col("x.hash").alias("hash")).agg(F.min(F.col("at") + F.col("x.j")).alias("first"))
    out = wanted.join(found, [*anchor, "hash"])
    return out.select(*[F.col(c) for c in resolved.columns], (F.col("node_start") + F.col("first")).alias("new_start"), (F.col("node_start") + F.col("first") + long_).alias("new_end"))


def check_fragment(endpoints: DataFrame, fragments: DataFrame | Callable[[DataFrame], DataFrame], sources: DataFrame) -> DataFrame:
    """layer, uuid, n, state, range_start, range_end of structural endpoints that name an anchor. The anchors are resolved and hashed once and written to the
    shared folder, with the text of those only that are neither equal nor restyled: in these the accepted text is looked for."""
    r = subrange_slice(anchor_resolve(endpoints, fragments)).join(sources.select("layer", "file", F.lit(True).alias("there")), ["layer", "file"], "left")
    state = (
        F.when(F.col("there").isNull(), "BROKEN").when(F.col("node_start").isNull(), "UNANCHORED").when(F.col("hash").isNull(), "PENDING")
        .when(F.col("hash") == T.digest(F.col("frag")), "OK").when(F.col("shape_hash") == T.digest(T.shape(F.col("node_text"))), "RESTYLED").otherwise("ALTERED")
    )
    r = r.select(*KEY, "file", "anchor_kind", "anchor_name", "hash", "accepted_len", "node_start", "node_text", "frag_start", "frag_end", state.alias("state"))
    r = durable(r.withColumn("node_text", F.when(F.col("state") == "ALTERED", F.col("node_text"))), "fragments-now")
    moved = find_displaced(r.filter("state = 'ALTERED'")).select(*KEY, "new_start", "new_end")
    out = r.drop("node_text").join(moved, KEY, "left")
    known = ~F.col("state").isin("BROKEN", "UNANCHORED")
    at = lambda new, old: F.when(known, F.coalesce(new, old)).cast("long")
    return out.select(*KEY, F.when(F.col("new_start").isNotNull(), "DISPLACED").otherwise(F.col("state")).alias("state"), at("new_start", "frag_start").alias("range_start"), at("new_end", "frag_end").alias("range_end"))


def structural_digests(endpoints: DataFrame) -> DataFrame:
    """layer, uuid, side_hash: the accepted digest of a record's structural side (side 0 first); null where it has none."""
    side = F.when(F.col("kind") == "structural", F.col("hash"))
    return endpoints.groupBy("layer", "uuid").agg(F.min_by(side, F.when(side.isNotNull(), F.col("n"))).alias("side_hash"))


def check_layer(endpoints: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """layer, uuid, n, state of layer endpoints, from the record of the same uuid in the layer that they point to. sides: structural_digests() of all
    records, where endpoints are not all of them."""
    mine = endpoints.filter("kind = 'layer'").select(*KEY, "target_layer", "hash")
    other = (structural_digests(endpoints) if sides is None else sides).select(F.col("layer").alias("target_layer"), "uuid", "side_hash", F.lit(True).alias("there"))
    state = (
        F.when(F.col("there").isNull(), F.when(F.col("hash").isNull(), "TODO").otherwise("BROKEN"))
        .when(F.col("side_hash").isNull() | F.col("hash").isNull(), "PENDING").when(F.col("hash") == F.col("side_hash"), "OK").otherwise("CHAIN_DIRTY")
    )
    none = F.lit(None).cast("long")
    return mine.join(other, ["target_layer", "uuid"], "left").select(*KEY, state.alias("state"), none.alias("range_start"), none.alias("range_end"))


def check_task(endpoints: DataFrame, tasks: DataFrame) -> DataFrame:
    """layer, uuid, n, state, range_start, range_end of task endpoints: the whole-file cascade on the task's text."""
    t = tasks.select("task_id", T.digest(F.col("text")).alias("now"), F.octet_length("text").cast("long").alias("n_bytes"))
    out = endpoints.filter("kind = 'task'").select(*KEY, "task_id", "hash").join(t, "task_id", "left")
    state = F.when(F.col("now").isNull(), "BROKEN").when(F.col("hash").isNull(), "PENDING").when(F.col("hash") == F.col("now"), "OK").otherwise("ALTERED")
    return out.select(*KEY, state.alias("state"), F.when(F.col("now").isNotNull(), F.lit(0).cast("long")).alias("range_start"), F.col("n_bytes").alias("range_end"))


def check_endpoints(endpoints: DataFrame, sources: DataFrame, fragments: DataFrame | Callable[[DataFrame], DataFrame], tasks: DataFrame) -> DataFrame:
    """layer, uuid, n, state, range_start, range_end of all endpoints."""
    return check_whole_file(endpoints, sources).unionByName(check_fragment(endpoints, fragments, sources)).unionByName(check_layer(endpoints)).unionByName(check_task(endpoints, tasks))


def touched_sources(sources: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The sources that structural endpoints lie in. Their digests are worked out from the text once more, above the join, so that other
    files' texts are not hashed; the list of files is written first, so that a short one is broadcast and no other file's text is shuffled."""
    files = durable(endpoints.filter("kind = 'structural'").select("layer", "file").distinct(), "touched-files")
    few = sources.select("layer", "file", "lang", "text").join(files, ["layer", "file"], "left_semi")
    return few.select("layer", "file", "lang", F.octet_length("text").cast("long").alias("n_bytes"), "text", T.digest(F.col("text")).alias("hash"))


def recheck(endpoints: DataFrame, changed: DataFrame, sources: DataFrame, fragments: Callable, tasks: DataFrame, reaccepted: DataFrame | None = None) -> DataFrame:
    """layer, uuid, n, state, range_start, range_end, rechecked of all endpoints, like check_endpoints(); those that can't have changed keep the
    state and range stored with them.

    changed (layer, uuid, n): ends to look at again, from prune_unchanged(); to these come ends without a stored state, structural ones whose
    file is gone, and layer ends of a record in `reaccepted` (layer, uuid) or of the neighbour of one; without that table all layer ends, which are
    checked by digests alone. Only the files that such ends lie in go on to `fragments` (a function from sources to their
    fragments or to named_fragments()) and are hashed."""
    files = sources.select("layer", "file")
    gone = endpoints.filter("kind = 'structural' and state <> 'BROKEN'").join(files, ["layer", "file"], "left_anti").select(*KEY)
    layers = endpoints.filter("kind = 'layer'")
    if reaccepted is not None:
        there = reaccepted.select(F.col("layer").alias("target_layer"), "uuid")
        layers = layers.join(reaccepted.select("layer", "uuid"), ["layer", "uuid"], "left_semi").select(*KEY).union(layers.join(there, ["target_layer", "uuid"], "left_semi").select(*KEY))
    dirty = durable(changed.select(*KEY).union(endpoints.filter("state is null").select(*KEY)).union(gone).union(layers.select(*KEY)).distinct(), "dirty-ends")
    again = endpoints.join(dirty, KEY, "left_semi")
    src = touched_sources(sources, again)
    sides = structural_digests(endpoints)
    now = check_whole_file(again, src).unionByName(check_fragment(again, fragments(src), src)).unionByName(check_layer(again, sides)).unionByName(check_task(again, tasks))
    kept = endpoints.join(dirty, KEY, "left_anti").select(*KEY, "state", "range_start", "range_end")
    return now.withColumn("rechecked", F.lit(True)).unionByName(kept.withColumn("rechecked", F.lit(False)))


def check_links(endpoints: DataFrame, sources: DataFrame, fragments: DataFrame | Callable[[DataFrame], DataFrame], tasks: DataFrame) -> DataFrame:
    """One row a record: both states and ranges, and whether any of them differs from what is stored."""
    now = check_endpoints(endpoints, sources, fragments, tasks)
    stored = endpoints.select(*KEY, F.col("state").alias("old_state"), F.col("range_start").alias("old_start"), F.col("range_end").alias("old_end"))
    same = F.col("state").eqNullSafe(F.col("old_state")) & F.col("range_start").eqNullSafe(F.col("old_start")) & F.col("range_end").eqNullSafe(F.col("old_end"))
    at = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    return now.join(stored, KEY).groupBy("layer", "uuid").agg(
        at("state", 0).alias("state0"), at("state", 1).alias("state1"), at("range_start", 0).alias("start0"), at("range_end", 0).alias("end0"),
        at("range_start", 1).alias("start1"), at("range_end", 1).alias("end1"), F.max(~same).alias("updated"),
    )


def clean_report(checked: DataFrame) -> DataFrame:
    """Records with a side that needs attention."""
    return checked.filter(~F.col("state0").isin(*CLEAN) | ~F.col("state1").isin(*CLEAN))


def worst_state(endpoints: DataFrame, *keys: str) -> DataFrame:
    """The worst state for each key; of equal ranks that of the higher n, then of the greater name."""
    order = F.struct(rank(F.col("state")), "n", F.coalesce("state", F.lit("NONE")))
    return endpoints.groupBy(*keys).agg(F.max_by(F.coalesce("state", F.lit("NONE")), order).alias("worst"))
