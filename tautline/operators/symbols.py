"""Symbols: definitions, call edges, innermost callables, states of recorded symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.functions.durable import durable
from tautline.operators.closure import closure
from tautline.operators.fragments import fragment_get
from tautline.operators.ranges import spans_around, spans_overlapping
from tautline.operators.sized import sized


def callable_definitions(definitions: DataFrame) -> DataFrame:
    return definitions.filter(F.col("symbol").endswith("()."))


def symbol_key(symbol):
    """The storage key of a symbol id (fixed values: what is replaced, and the suffix)."""
    s = F.regexp_replace(symbol, r"^(?:scip://)+", "")
    for a, b in (("/", "."), ("#", ".."), ("()", ""), (" ", "")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.regexp_replace(s, r"\.+$", ""), F.lit(".sciplink"))


def symbol_id_collisions(symbols: DataFrame) -> DataFrame:
    """key, symbols: storage keys that several symbols share."""
    return symbols.select("symbol").distinct().groupBy(symbol_key(F.col("symbol")).alias("key")).agg(F.count("*").alias("symbols")).filter("symbols > 1")


def occurrence_ranges(raw: DataFrame, lines: DataFrame) -> DataFrame:
    """raw (layer, file, id, line, from_char, to_line, to_char; to_line null: the same) -> id, start, end in bytes; rows without their file go."""
    at = lambda text, char: F.octet_length(F.left(text, char))
    first = lines.select("layer", "file", "line", F.col("start").alias("s1"), F.col("text").alias("t1"))
    last = lines.select("layer", "file", F.col("line").alias("to_line"), F.col("start").alias("s2"), F.col("text").alias("t2"))
    r = raw.withColumn("to_line", F.coalesce("to_line", "line")).join(first, ["layer", "file", "line"]).join(last, ["layer", "file", "to_line"])
    return r.select("id", (F.col("s1") + at("t1", F.col("from_char"))).alias("start"), (F.col("s2") + at("t2", F.col("to_char"))).alias("end"))


def symbol_definitions(occurrences: DataFrame, declarations: DataFrame) -> DataFrame:
    """symbol, file, name_start, name_end, body_start, body_end: defining occurrences (role bit 1), later documents first; the body is the
    innermost declaration around the name, else the name."""
    names = occurrences.filter(F.col("roles").bitwiseAND(F.lit(1)) == 1)
    last = names.groupBy("symbol").agg(F.max_by(F.struct("file", "start", "end"), "doc_seq").alias("d")).select("symbol", "d.*")
    around = spans_around(last, declarations.select("file", F.col("start").alias("o_start"), F.col("end").alias("o_end")), ["file"])
    body = around.groupBy("symbol").agg(F.min(F.struct((F.col("o_end") - F.col("o_start")).alias("size"), "o_start", "o_end")).alias("b"))
    return last.join(body.hint("merge"), "symbol", "left").select("symbol", "file", F.col("start").alias("name_start"), F.col("end").alias("name_end"), F.coalesce("b.o_start", "start").alias("body_start"), F.coalesce("b.o_end", "end").alias("body_end"))


def occurrences_in_range(spans: DataFrame, occurrences: DataFrame) -> DataFrame:
    """spans (file, o_start, o_end, ...) joined with the occurrences (file, symbol, start, end) inside them."""
    return spans_around(occurrences, spans, ["file"], hint="shuffle_hash")


def direct_callees(definitions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """caller, callee: callables with a definition that are referred to inside another one's body."""
    bodies = definitions.select(F.col("symbol").alias("caller"), "file", F.col("body_start").alias("o_start"), F.col("body_end").alias("o_end"))
    uses = occurrences.filter((F.col("roles").bitwiseAND(F.lit(1)) == 0) & F.col("symbol").endswith("().")).select(F.col("symbol").alias("callee"), "file", "start", "end")
    found = spans_around(uses, bodies, ["file"], hint="shuffle_hash").filter("caller <> callee").select("caller", "callee").distinct()
    return found.join(definitions.select(F.col("symbol").alias("callee")).hint("shuffle_hash"), "callee", "left_semi").select("caller", "callee")


def callable_at(spans: DataFrame, definitions: DataFrame) -> DataFrame:
    """spans (file, start, end) with the innermost callable around each; equal sizes: the smallest symbol. Equal spans come out once;
    they are folded after the join, which passes them on one by one and drops those outside of every callable."""
    d = callable_definitions(definitions).select("file", "symbol", F.col("body_start").alias("o_start"), F.col("body_end").alias("o_end"))
    hit = spans_around(spans, d, ["file"], hint="shuffle_hash")
    return hit.groupBy("file", "start", "end").agg(F.min(F.struct((F.col("o_end") - F.col("o_start")).alias("size"), "symbol"))["symbol"].alias("symbol"))


def callable_in_file(definitions: DataFrame) -> DataFrame:
    return callable_definitions(definitions).groupBy("file").agg(F.min("symbol").alias("symbol"))


def declaration_by_name(names: DataFrame, fragments: DataFrame, kinds: list[str]) -> DataFrame:
    """names (file, name) with the span of the declaration of that name, the kinds tried in order, the first place of a kind."""
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    hit = names.join(fragments.filter(F.col("kind").isin(kinds)).hint("merge"), ["file", "name"])
    return hit.groupBy("file", "name").agg(F.min(F.struct(order.alias("o"), "start", "end")).alias("d")).select("file", "name", "d.start", "d.end")


def symbol_check(bodies: DataFrame, recorded: DataFrame) -> DataFrame:
    """bodies (symbol, text), recorded (symbol, hash) -> symbol, state, is_new: no record or an equal digest is OK, else ALTERED."""
    b = bodies.select("symbol", T.digest(F.col("text")).alias("now")).join(recorded.select("symbol", "hash", F.lit(True).alias("there")).hint("merge"), "symbol", "left")
    state = F.when(F.col("there").isNull() | (F.col("hash") == F.col("now")), "OK").otherwise("ALTERED")
    return b.select("symbol", state.alias("state"), F.col("there").isNull().alias("is_new"))


def symbol_renames(recorded: DataFrame, definitions: DataFrame) -> DataFrame:
    """recorded (symbol, file, start, end) that the index has no more: RENAMED to the smallest symbol whose name overlaps the place, else DELETED."""
    gone = recorded.join(definitions.select("symbol").hint("merge"), "symbol", "left_anti").select("symbol", "file", "start", "end")
    names = definitions.select(F.col("symbol").alias("new_symbol"), "file", F.col("name_start").alias("o_start"), F.col("name_end").alias("o_end"))
    new = spans_overlapping(gone, names, ["file"]).groupBy("symbol").agg(F.min("new_symbol").alias("new_symbol"))
    return gone.join(new.hint("merge"), "symbol", "left").select("symbol", F.when(F.col("new_symbol").isNull(), "DELETED").otherwise("RENAMED").alias("state"), "new_symbol")


def subgraph_check(roots: DataFrame, callees: DataFrame, checked: DataFrame, renamed: DataFrame) -> DataFrame:
    """roots (root) -> root, symbol, state of every symbol reached along callees (caller, callee), cycles included. States are those of
    symbol_check(); a recorded symbol that the index has no more has that of symbol_renames() and leads no further."""
    edges = callees.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    reached = closure(roots.select("root", F.col("root").alias("node")), edges)
    states = checked.select(F.col("symbol").alias("node"), "state").unionByName(renamed.select(F.col("symbol").alias("node"), "state"))
    return reached.join(states.hint("merge"), "node").select("root", F.col("node").alias("symbol"), "state")


def subgraph_health(roots: DataFrame, callees: DataFrame, states: DataFrame) -> DataFrame:
    """roots (root) with healthy: whether all symbols reached from each are OK or PENDING (unknown ones count as PENDING). Trouble is spread backwards
    from where it is, so that the work of all roots together is one closure."""
    edges = callees.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    bad = states.filter(~F.col("state").isin("OK", "PENDING")).select(F.lit("bad").alias("root"), F.col("symbol").alias("node"))
    spoilt = closure(bad, edges).select(F.col("node").alias("root"), F.lit(False).alias("healthy"))
    return roots.join(spoilt.hint("merge"), "root", "left").select("root", F.coalesce("healthy", F.lit(True)).alias("healthy"))


def callee_tree(reached: DataFrame, definitions: DataFrame, lines: DataFrame) -> DataFrame:
    """reached (symbol, depth) with file, body_start, body_end, the lines that the body stands on (first_line, last_line) and their text (content);
    lines (file, line, start, end, text)."""
    at = durable(sized(durable(reached, "reached")).join(definitions, "symbol").select("symbol", "depth", "file", "body_start", "body_end"), "callees")
    spans = at.select(F.lit(".").alias("layer"), "file", F.col("symbol").alias("id"), F.col("body_start").alias("start"), F.col("body_end").alias("end"))
    return at.join(fragment_get(spans, lines).withColumnRenamed("id", "symbol").hint("merge"), "symbol", "left").select("symbol", "depth", "file", "body_start", "body_end", "first_line", "last_line", "content")


def link_symbol_retrofit(ends: DataFrame, definitions: DataFrame) -> DataFrame:
    """ends (id, file, start, end, subgraph) with missing subgraph symbols filled: from the range where there is one, else from the file."""
    by_range = callable_at(ends.filter("subgraph is null and start is not null").select("file", "start", "end"), definitions).withColumnRenamed("symbol", "r")
    by_file = callable_in_file(definitions).withColumnRenamed("symbol", "f")
    out = ends.join(by_range, ["file", "start", "end"], "left").join(by_file, "file", "left")
    return out.select("id", "file", F.coalesce("subgraph", F.when(F.col("start").isNotNull(), F.col("r")).otherwise(F.col("f"))).alias("subgraph"))
