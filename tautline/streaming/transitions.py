"""Transitions of link ends from a stream of file changes and acceptances, by keyed state.

The state of Spark's state store is keyed by uuid: the records of one chain, whose ends look at each other, are one group (a few records). Each end has
its stored baseline, what its file last said, and its state. Digests are worked out by Spark before the rows reach their group; the group only
compares, and looks an accepted text up in its anchor where nothing else fits.
"""

from __future__ import annotations

import hashlib
import json
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tautline.functions import text as T
from tautline.operators.check import KEY

Change = namedtuple("Change", ["event_id", "what", "layer", "n", "there", "now_hash", "now_shape", "node", "hash", "shape_hash", "accepted_len"])
OUT = "uuid string, layer string, n int, step long, event_id long, state string, new_state string"


def _displaced(node: str, digest: str, size: int | None) -> bool:
    """Whether a window of `size` bytes of the anchor has the digest."""
    raw = node.encode()
    return bool(size) and any(hashlib.sha256(raw[k : k + size]).hexdigest() == digest for k in range(len(raw) - size + 1))


def structural_state(end: dict, searched: dict | None = None) -> str | None:
    """The state of a structural or task end from its baseline and what its file last said; its stored one if the file hasn't spoken yet. searched: results of
    searches for accepted texts so far, which this one adds to."""
    seen = end.get("seen")
    if seen is None:
        return "OK" if end.get("accepted") else end["state"]
    if not seen["there"]:
        return "BROKEN"
    if seen["hash"] is None:
        return "UNANCHORED"
    if end["hash"] is None:
        return "PENDING"
    if end["hash"] == seen["hash"]:
        return "OK"
    if end["anchored"]:
        if end["shape_hash"] is not None and end["shape_hash"] == seen["shape_hash"]:
            return "RESTYLED"
        searched, key = {} if searched is None else searched, (end["hash"], end["accepted_len"], seen["node"])
        if key not in searched:
            searched[key] = _displaced(key[2], key[0], key[1])
        if searched[key]:
            return "DISPLACED"
    return "ALTERED"


def layer_state(end: dict, ends: list[dict]) -> str:
    """The state of a layer end: its digest against the accepted one of the structural side (side 0 first) of the record that it points to."""
    there = [x for x in ends if x["layer"] == end["target_layer"]]
    side = next((x["hash"] for x in sorted(there, key=lambda x: x["n"]) if x["kind"] == "structural" and x["hash"] is not None), None)
    if not there:
        return "TODO" if end["hash"] is None else "BROKEN"
    if side is None or end["hash"] is None:
        return "PENDING"
    return "OK" if end["hash"] == side else "CHAIN_DIRTY"


def _value(x):
    return None if x is None or x != x else x


def _transitions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    batches = [x for x in batches if len(x)]
    rows = [Change(*r) for x in batches for r in zip(*[x[c].tolist() for c in Change._fields], strict=True)]
    rows.sort(key=lambda r: r[:4])  # groups are many and small: sorting frames takes longer than all else
    ends, step = (json.loads(state.get[0]), state.get[1]) if state.exists else (json.loads(batches[0]["ends"].iloc[0]), 0)
    by, out = {(x["layer"], x["n"]): x for x in ends}, []
    searched: dict = {}  # a text that a file has again is not searched again
    for r in rows:
        end, last = by.get((r.layer, r.n)), f"last_{r.what}"
        if end is None or int(r.event_id) <= end.get(last, -(1 << 63)):
            continue  # late, or the same again
        end[last] = int(r.event_id)
        if r.what == "file":
            end["seen"] = {"there": bool(r.there), "hash": _value(r.now_hash), "shape_hash": _value(r.now_shape), "node": _value(r.node)}
        else:
            end |= {"hash": _value(r.hash), "shape_hash": _value(r.shape_hash), "accepted_len": None if _value(r.accepted_len) is None else int(r.accepted_len), "accepted": True}
        near = [end] if r.what == "file" else [end, *[x for x in ends if x["kind"] == "layer" and x["target_layer"] == end["layer"] and x is not end]]
        for x in near:
            new = layer_state(x, ends) if x["kind"] == "layer" else structural_state(x, searched)
            if new != x["state"]:
                step += 1
                out.append((key[0], x["layer"], x["n"], step, int(r.event_id), x["state"], new))
                x["state"] = new
    state.update((json.dumps(ends), step))
    yield pd.DataFrame(out, columns=["uuid", "layer", "n", "step", "event_id", "state", "new_state"])


def transitions(changes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """uuid, layer, n, step, event_id, state (before), new_state: each change of an end's state that a stream of changes brings about. step counts a uuid's
    transitions in the order in which they came about, which late events make another one than that of event_id.

    changes: event_id, what, layer; for what = 'file' a file and its text from then on (null: it is gone), for what = 'accept' a uuid and n with the
    hash, shape_hash and accepted_len that this end accepts. endpoints: the links' ends with their stored baselines and states (null: none yet); ends name a
    whole file or a line of it. Changes of one end count in the order of their event_id, whatever batches they come in: one that is older than the last of its kind
    is late and changes nothing. What has been accepted without a change of the file is OK."""
    anchored = F.col("anchor_name").isNotNull()
    ends = endpoints.select("uuid", F.struct("layer", "n", "kind", "target_layer", "hash", "shape_hash", "accepted_len", "state", anchored.alias("anchored")).alias("e"))
    chain = ends.groupBy("uuid").agg(F.to_json(F.array_sort(F.collect_list("e")), {"ignoreNullFields": "false"}).alias("ends"))
    named = endpoints.filter("kind = 'structural'").select(*KEY, "file", "anchor_name", "rel_start", "rel_end").join(chain, "uuid")
    none = lambda t: F.lit(None).cast(t)
    files = changes.filter("what = 'file'").select("event_id", "layer", "file", "text").join(named, ["layer", "file"])
    number = F.regexp_extract("anchor_name", "^L([0-9]+)$", 1).try_cast("int")
    line = F.when(number >= 1, F.get(F.split("text", "\n"), number - 1))
    node = F.when(F.col("anchor_name").isNotNull(), line)
    part = F.when(F.col("rel_start").isNull() & F.col("rel_end").isNull(), node).otherwise(T.byte_slice(node, F.coalesce("rel_start", F.lit(0)), F.least(F.coalesce("rel_end", F.octet_length(node).cast("long")), F.octet_length(node).cast("long"))))
    whole = F.col("anchor_name").isNull()
    columns = [*KEY, "event_id", "what", "there", "now_hash", "now_shape", "node", "hash", "shape_hash", "accepted_len", "ends"]
    files = files.select(
        *KEY, "event_id", F.lit("file").alias("what"), F.col("text").isNotNull().alias("there"), T.digest(F.when(whole, F.col("text")).otherwise(part)).alias("now_hash"), T.digest(T.shape(node)).alias("now_shape"), node.alias("node"),
        none("string").alias("hash"), none("string").alias("shape_hash"), none("long").alias("accepted_len"), "ends",
    )
    accepts = changes.filter("what = 'accept'").select(*KEY, "event_id", "what", "hash", "shape_hash", "accepted_len").join(chain, "uuid")
    accepts = accepts.withColumns({"there": none("boolean"), "now_hash": none("string"), "now_shape": none("string"), "node": none("string")})
    rows = files.select(*columns).unionByName(accepts.select(*columns))
    return rows.groupBy("uuid").applyInPandasWithState(_transitions, OUT, "ends string, step long", "append", GroupStateTimeout.NoTimeout)
