"""Fragments: line tables, anchors, resolution of anchors, slices, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.functions.durable import durable
from tautline.operators.ranges import spans_around, spans_containing, spans_overlapping
from tautline.operators.sized import FEW

#: Rules: language, kind of anchor, a line that opens one (group 1: its name). They are data; more rows add more anchors.
RULES = [
    ("markdown", "heading", r"^#{1,6} +(.+?) *$"),
    ("java", "declaration", r"^ *(?:(?:public|private|protected|static|final|abstract) +)+[\w<>\[\], ]*?(\w+) *[({]"),
    ("rust", "declaration", r"^ *(?:pub(?:\([^)]*\))? +)?(?:fn|struct|enum|trait|impl|mod) +(\w+)"),
]

#: Pieces that HTML is cut into: comments, scripts and styles whole, tags, text. Elements that have no closing tag.
HTML_PIECE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+|<"
HTML_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

#: A heading of HTML at the start of a text: its tag's name, what stands in it.
HEADING = r"(?is)^<(h[1-6])(?:\s[^>]*)?>(.*?)</h[1-6]\s*>"


def line_offsets(sources: DataFrame) -> DataFrame:
    """layer, file, line (from 1), start, end (bytes, without the line break), text. Worked out within each row: texts are not shuffled."""
    lines = F.split("text", "\n")
    starts = T.running_starts(F.transform(lines, lambda x: F.octet_length(x).cast("long") + 1))
    each = sources.select("layer", "file", F.posexplode(F.zip_with(lines, starts, lambda x, a: F.struct(x.alias("text"), a.alias("start")))).alias("i", "l"))
    return each.select("layer", "file", (F.col("i") + 1).alias("line"), "l.start", (F.col("l.start") + F.octet_length("l.text")).alias("end"), "l.text")


def headings(sources: DataFrame) -> DataFrame:
    """All headings of HTML sources as anchors: name (h1 to h6), ord among the file's headings, depth (its level), the span and text between the tags."""
    cut = F.split("text", r"(?i)(?=<h[1-6][\s>])")
    starts = T.running_starts(F.transform(cut, lambda x: F.octet_length(x).cast("long")))
    pieces = F.zip_with(cut, starts, lambda p, at: F.struct(p.alias("p"), at.alias("at")))
    inside = lambda p, g: F.regexp_extract(p, HEADING, g)
    found = F.filter(pieces, lambda x: inside(x["p"], 1) != "")
    each = sources.filter("lang = 'html'").select("layer", "file", F.posexplode(found).alias("i", "x")).select("layer", "file", "i", F.col("x.p").alias("p"), F.col("x.at").alias("at"))
    name, start = F.lower(inside(F.col("p"), 1)), F.col("at") + F.octet_length(F.regexp_extract("p", r"(?i)^<h[1-6](?:\s[^>]*)?>", 0))
    each = each.select("layer", "file", F.lit("heading").alias("kind"), name.alias("name"), (F.col("i") + 1).alias("ord"), start.alias("start"), inside(F.col("p"), 2).alias("text"))
    return each.withColumn("end", F.col("start") + F.octet_length("text")).withColumn("depth", F.substring("name", 2, 1).cast("int"))


def elements(sources: DataFrame) -> DataFrame:
    """All elements of HTML sources that are closed by a tag of their own, as anchors: name (of the tag, in lower case), ord among the file's elements, depth (how many
    of these are around it), the span and text between the tags. Comments, scripts and styles are passed over; elements left open are left out.

    A file is cut into its pieces within its row, and only tags leave it. A name's openings and closings alternate on each level of its running
    depth, so an opening's closing tag is the next one of its name and level. Texts are cut from the file's row, once for all of its elements."""
    pieces = F.regexp_extract_all("text", F.lit(HTML_PIECE), F.lit(0))
    starts = T.running_starts(F.transform(pieces, lambda x: F.octet_length(x).cast("long")))
    tag = lambda x, g: F.regexp_extract(x, "^<(/?)([a-zA-Z][a-zA-Z0-9]*)", g)
    placed = F.filter(F.zip_with(pieces, starts, lambda x, at: F.struct(F.lower(tag(x, 2)).alias("name"), (tag(x, 1) == "/").alias("closes"), at.alias("at"), (at + F.octet_length(x)).alias("after"), F.endswith(x, F.lit("/>")).alias("single"))), lambda x: ~x["name"].isin("", "script", "style", *HTML_VOID) & ~x["single"])
    html = sources.filter("lang = 'html'")
    tags = html.select("layer", "file", F.explode(placed).alias("t")).select("layer", "file", "t.name", "t.closes", F.col("t.at").alias("pos"), "t.after")
    step = F.when(F.col("closes"), -1).otherwise(1)
    running = F.sum(step).over(Window.partitionBy("layer", "file", "name").orderBy("pos"))
    level = tags.withColumn("level", running + F.col("closes").cast("int"))
    same = Window.partitionBy("layer", "file", "name", "level").orderBy("pos")
    both = level.withColumns({"next_closes": F.lead("closes").over(same), "end": F.lead("pos").over(same), "opened": F.lag("closes").over(same)})
    both = both.filter((~F.col("closes") & F.col("next_closes")) | (F.col("closes") & ~F.col("opened")))
    around = F.sum(step).over(Window.partitionBy("layer", "file").orderBy("pos"))
    opened = both.withColumn("depth", around - 1).filter("not closes")
    spans = opened.groupBy("layer", "file").agg(F.array_sort(F.collect_list(F.struct(F.col("after").alias("start"), "end", "name", "depth"))).alias("spans"))
    cut = lambda x: F.struct(x["name"].alias("name"), x["depth"].alias("depth"), x["start"].alias("start"), x["end"].alias("end"), T.byte_slice(F.col("text"), x["start"], x["end"]).alias("text"))
    each = html.select("layer", "file", "text").join(spans, ["layer", "file"]).select("layer", "file", F.posexplode(F.transform("spans", cut)).alias("i", "x"))
    return each.select("layer", "file", F.lit("element").alias("kind"), "x.name", (F.col("i") + 1).alias("ord"), "x.depth", "x.start", "x.end", "x.text")


def fragments_extract(sources: DataFrame, kinds: tuple[str, ...] = ("line", "paragraph", "element"), rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """layer, file, kind, name, ord, depth, start, end, text: lines (L1, L2, ...), paragraphs (P1, ...: runs of lines with text), elements of
    HTML (the tag's name), of kind heading those alone, and, of kind declaration, what the rules find. depth: how deep an anchor is nested, 0 for lines
    and paragraphs, a heading's level."""
    lines = line_offsets(sources)
    out = []
    if "line" in kinds:
        out.append(lines.select("layer", "file", F.lit("line").alias("kind"), F.concat(F.lit("L"), F.col("line").cast("string")).alias("name"), F.col("line").alias("ord"), F.lit(0).alias("depth"), "start", "end", "text"))
    if "paragraph" in kinds:
        w = Window.partitionBy("layer", "file").orderBy("line")
        full = lines.withColumn("run", F.sum((F.trim("text") == "").cast("int")).over(w)).filter(F.trim("text") != "")
        runs = full.groupBy("layer", "file", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
        ord_ = F.row_number().over(Window.partitionBy("layer", "file").orderBy("start"))
        out.append(runs.withColumn("ord", ord_).select("layer", "file", F.lit("paragraph").alias("kind"), F.concat(F.lit("P"), F.col("ord").cast("string")).alias("name"), "ord", F.lit(0).alias("depth"), "start", "end", "text"))
    if "element" in kinds:
        out.append(elements(sources))
    if "heading" in kinds:
        out.append(headings(sources))
    if "declaration" in kinds:
        out.append(declarations(sources, rules))
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first.select("layer", "file", "kind", "name", F.col("ord").cast("int").alias("ord"), F.col("depth").cast("int").alias("depth"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


def declarations(sources: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """layer, file, kind, name, ord, depth, start, end, text: anchors opened by a rule's line, up to the next one that is nested no deeper.
    depth: open braces before the line, in Markdown the heading's level less one. Worked out within each row."""
    lines = F.split("text", "\n")
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for lang, k, pattern in rules:
        here = F.col("lang") == lang
        kind = F.when(here, F.lit(k)).otherwise(kind)
        name = F.when(here, F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1))).otherwise(name)  # noqa: B023
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    open_ = T.running_starts(F.transform(lines, lambda x: (count(x, "{") - count(x, "}")).cast("long")))
    level = F.transform(lines, lambda x: (F.length(F.regexp_extract(x, "^#+", 0)) - 1).cast("long"))
    starts = T.running_starts(F.transform(lines, lambda x: F.octet_length(x).cast("long") + 1))
    wanted = sources.filter(F.col("lang").isin([r[0] for r in rules])).withColumns({"kind": kind, "names": name, "starts": starts, "depths": F.when(F.col("lang") == "markdown", level).otherwise(open_)})
    found = F.filter(F.arrays_zip("names", "starts", "depths"), lambda x: x["names"] != "")
    wanted = wanted.withColumn("found", found)
    # ends and texts are worked out inside the array, so that the file is not copied for each of its declarations
    after = lambda x, i: F.filter(F.slice("found", i + 2, F.size("found")), lambda y: y["depths"] <= x["depths"])
    end = lambda x, i: F.coalesce(F.get(after(x, i), F.lit(0))["starts"] - 1, F.col("n_bytes"))
    spans = F.transform("found", lambda x, i: F.struct(x["names"].alias("name"), x["depths"].alias("depth"), x["starts"].alias("start"), end(x, i).alias("end")))
    cut = F.transform("spans", lambda x: F.struct(*[x[c].alias(c) for c in ("name", "depth", "start", "end")], T.byte_slice(F.col("text"), x["start"], x["end"]).alias("text")))
    each = wanted.withColumn("spans", spans).select("layer", "file", "kind", F.posexplode(cut).alias("i", "x"))
    return each.select("layer", "file", "kind", "x.name", (F.col("i") + 1).alias("ord"), F.col("x.depth").cast("int").alias("depth"), "x.start", "x.end", "x.text")


def fingerprint(fragments: DataFrame) -> DataFrame:
    """fragments with hash (exact text) and shape_hash."""
    return fragments.withColumn("hash", T.digest(F.col("text"))).withColumn("shape_hash", T.digest(T.shape(F.col("text"))))


def named_fragments(sources: DataFrame, kinds: tuple[str, ...] = ("line",)) -> Callable[[DataFrame], DataFrame]:
    """fragments_extract() for anchor_resolve(): a function from the anchors asked for (layer, file, anchor_kind, anchor_name) to these fragments (layer, file, kind,
    name, start, end, text) alone.

    Asked lines of a file are gathered to one row, which the file's text meets once; it is cut there, so that of all lines only asked ones are shuffled and
    nothing sorts texts. Anchors of other kinds have to be looked for in the whole files that they are asked in."""
    place = ["layer", "file"]

    def of(asked: DataFrame) -> DataFrame:
        number = F.regexp_extract("anchor_name", "^L([1-9][0-9]*)$", 1).try_cast("int")
        held = asked.filter("anchor_kind = 'line'").withColumn("line", number).filter("line is not null").groupBy(*place).agg(F.collect_set("line").alias("asked"))
        met = held.hint("shuffle_hash").join(sources.select(*place, "text"), place).select(*place, "asked", F.split("text", "\n").alias("lines"))
        met = met.withColumn("starts", T.running_starts(F.transform("lines", lambda x: F.octet_length(x).cast("long") + 1)))
        each = F.transform("asked", lambda k: F.struct(k.alias("line"), F.get("starts", k - 1).alias("start"), F.get("lines", k - 1).alias("text")))
        each = met.select(*place, F.explode(each).alias("x")).select(*place, "x.*").filter("text is not null")
        lines = each.select(*place, F.lit("line").alias("kind"), F.concat(F.lit("L"), F.col("line").cast("string")).alias("name"), "start", (F.col("start") + F.octet_length("text")).alias("end"), "text")
        rest = tuple(k for k in kinds if k != "line")
        if rest:
            files = asked.filter("anchor_kind <> 'line'").select(*place).distinct()
            found = fragments_extract(files.hint("shuffle_hash").join(sources, place).select(sources.columns), rest).select(*lines.columns)
            lines = lines.unionByName(found) if "line" in kinds else found
        return lines

    return of


def anchor_resolve(endpoints: DataFrame, fragments: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Structural endpoints that name an anchor, with node_start, node_end, node_text of the first anchor of that kind and name in
    document order (null: unanchored). fragments: a table of them, or named_fragments(), which looks only for those that are named."""
    if not isinstance(fragments, DataFrame):
        fragments = fragments(endpoints.filter("kind = 'structural' and anchor_name is not null").select("layer", "file", "anchor_kind", "anchor_name"))
    first = fragments.groupBy("layer", "file", F.col("kind").alias("anchor_kind"), F.col("name").alias("anchor_name")).agg(F.min_by(F.struct("start", "end", "text"), "start").alias("node"))
    named = endpoints.filter("kind = 'structural' and anchor_name is not null")
    return named.join(first, ["layer", "file", "anchor_kind", "anchor_name"], "left").select(named["*"], F.col("node.start").alias("node_start"), F.col("node.end").alias("node_end"), F.col("node.text").alias("node_text"))


def subrange_slice(resolved: DataFrame) -> DataFrame:
    """resolved with frag_start, frag_end, frag: the relative range inside the anchor, or the whole anchor; its end is clamped."""
    end = F.least(F.col("node_start") + F.coalesce("rel_end", F.col("node_end") - F.col("node_start")), "node_end")
    out = resolved.withColumn("frag_start", F.col("node_start") + F.coalesce("rel_start", F.lit(0))).withColumn("frag_end", end)
    whole = F.col("rel_start").isNull() & F.col("rel_end").isNull()
    return out.withColumn("frag", F.when(whole, F.col("node_text")).otherwise(T.byte_slice(F.col("node_text"), F.col("frag_start") - F.col("node_start"), F.col("frag_end") - F.col("node_start"))))


def positions(points: DataFrame, lines: DataFrame, unit: str = "char") -> DataFrame:
    """points (layer, file, line, col: both from 1, any others) with `at`, the byte in the file; col counts characters or, with unit 'byte', bytes of the
    line. The place after a line's last character counts as its end; one further on, or a line that the file hasn't, is null."""
    width = F.length("_text") if unit == "char" else F.octet_length("_text")
    before = F.octet_length(F.left("_text", F.col("col") - 1)) if unit == "char" else F.col("col") - 1
    there = lines.select("layer", "file", "line", F.col("start").alias("_start"), F.col("text").alias("_text"))
    at = F.when((F.col("col") >= 1) & (F.col("col") - 1 <= width), F.col("_start") + before)
    return points.join(there, ["layer", "file", "line"], "left").withColumn("at", at.cast("long")).drop("_start", "_text")


def selection_spans(selections: DataFrame, lines: DataFrame, unit: str = "char") -> DataFrame:
    """selections (id, layer, file, from_line, from_col, to_line, to_col) as bytes: id, layer, file, sel_start, sel_end. Both ends are looked up in the line
    table in one join; selections with an end outside the file are left out."""
    end = lambda which, line, col: F.struct(F.lit(which).alias("which"), F.col(line).cast("int").alias("line"), F.col(col).cast("int").alias("col"))
    both = selections.select("id", "layer", "file", F.explode(F.array(end(0, "from_line", "from_col"), end(1, "to_line", "to_col"))).alias("e")).select("id", "layer", "file", "e.*")
    at = lambda which: F.max(F.when(F.col("which") == which, F.col("at")))
    found = positions(both, lines, unit).groupBy("id", "layer", "file").agg(at(0).alias("sel_start"), at(1).alias("sel_end"))
    return found.filter("sel_start is not null and sel_end >= sel_start")


#: Selections in one anchor whose digests are worked out together.
TOGETHER = 1000


def anchor_capture(selections: DataFrame, fragments: DataFrame) -> DataFrame:
    """selections (layer, file, sel_start, sel_end) with the innermost anchor around each, the next larger one, the range relative to
    the innermost (null for a point or an exact fit) and the digest of what is selected. Anchors are found by their spans alone; an anchor's text then
    meets its selections once, TOGETHER of them at a time."""
    inner = selections.select("layer", "file", F.col("sel_start").alias("start"), F.col("sel_end").alias("end")).distinct()
    outer = fragments.select("layer", "file", "kind", "name", F.col("start").alias("o_start"), (F.col("end") + 1).alias("o_end"))  # a point at the end is inside
    around = spans_around(inner, outer, ["layer", "file"]).filter("end < o_end")
    size = F.struct((F.col("o_end") - 1 - F.col("o_start")).alias("size"), "kind", "name", F.col("o_start").alias("start"), (F.col("o_end") - 1).alias("end"))
    two = around.groupBy("layer", "file", F.col("start").alias("sel_start"), F.col("end").alias("sel_end")).agg(F.slice(F.sort_array(F.collect_list(size)), 1, 2).alias("two"))
    anchor = ["layer", "file", "kind", "name", "start", "end"]
    two = two.select("layer", "file", "sel_start", "sel_end", "two", F.get("two", F.lit(0)).alias("a")).select("layer", "file", "sel_start", "sel_end", F.get("two", F.lit(1))["name"].alias("parent_name"), *[f"a.{c}" for c in anchor[2:]])
    exact = (F.col("sel_start") == F.col("sel_end")) | ((F.col("sel_start") == F.col("start")) & (F.col("sel_end") == F.col("end")))
    rel = lambda c: F.when(~exact, F.col(c) - F.col("start"))
    each = two.select(*anchor, "sel_start", "sel_end", "parent_name", rel("sel_start").alias("rel_start"), rel("sel_end").alias("rel_end"))
    turn = F.floor((F.row_number().over(Window.partitionBy(*anchor).orderBy("sel_start", "sel_end")) - 1) / TOGETHER)
    held = each.withColumn("turn", turn).groupBy(*anchor, "turn").agg(F.collect_list(F.struct("sel_start", "sel_end", "parent_name", "rel_start", "rel_end")).alias("held"))
    texts = fragments.select(*anchor, "text").join(each.select(*anchor).distinct(), anchor, "left_semi").dropDuplicates(anchor)
    whole = lambda x: x["rel_start"].isNull()
    digest = lambda x: T.digest(F.when(whole(x), F.col("text")).otherwise(T.byte_slice(F.col("text"), x["rel_start"], x["rel_end"])))
    out = held.join(texts, anchor).select("layer", "file", "kind", "name", F.explode(F.transform("held", lambda x: F.struct(x.alias("s"), digest(x).alias("hash")))).alias("x"))
    return out.select("layer", "file", "x.s.sel_start", "x.s.sel_end", "kind", "name", "x.s.parent_name", "x.s.rel_start", "x.s.rel_end", "x.hash")


def fragment_get(spans: DataFrame, lines: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """spans (layer, file, id, start, end) -> id, first_line, last_line, content: the whole lines that the span touches, with
    `before` and `after` more lines, clamped to the file. Lines stay where they are if the spans are few."""
    touched = spans.select("layer", "file", "id", "start", F.greatest(F.col("start") + 1, "end").alias("end"))
    hit = spans_overlapping(touched, lines.select("layer", "file", "line", F.col("start").alias("o_start"), (F.col("end") + 1).alias("o_end")), ["layer", "file"])
    at = durable(hit.groupBy("id", "layer", "file").agg((F.min("line") - before).alias("start"), (F.max("line") + after + 1).alias("end")), "spans-lines")
    few = at.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    got = spans_containing(lines.select("layer", "file", "line", "text"), at, ["layer", "file"], at="line", width=64, hint="broadcast" if few <= FEW else "merge")
    return got.groupBy("id").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))


def opposite_fragment(asked: DataFrame, endpoints: DataFrame, sources: DataFrame, fragments: DataFrame | Callable[[DataFrame], DataFrame], before: int = 0, after: int = 0) -> DataFrame:
    """asked (layer, uuid, n) -> layer, uuid, n, route, file, first_line, last_line, content: what stands at the other end of each end's record. Where that
    end is structural, it is that (route: side); where it points to a layer, the structural side (side 0 first) of the record there (route: layer).
    An end that names an anchor gives its whole lines with `before` and `after` more, one that names a file the whole of it. Ends whose other
    side has no text now are left out."""
    place = ["layer", "file", "anchor_kind", "anchor_name", "rel_start", "rel_end"]
    to = F.struct(*place)
    other = asked.select("layer", "uuid", F.col("n").alias("from_n"), (1 - F.col("n")).alias("n")).join(endpoints.select("layer", "uuid", "n", "kind", "target_layer", to.alias("to")), ["layer", "uuid", "n"])
    key = [F.col("layer").alias("from_layer"), "uuid", "from_n"]
    side = other.filter("kind = 'structural'").select(*key, F.lit("side").alias("route"), "to")
    first = endpoints.filter("kind = 'structural'").groupBy(F.col("layer").alias("target_layer"), "uuid").agg(F.min_by(to, "n").alias("to"))
    hop = other.filter("kind = 'layer'").drop("to").join(first, ["target_layer", "uuid"]).select(*key, F.lit("layer").alias("route"), "to")
    dest = side.unionByName(hop).select("from_layer", "uuid", "from_n", "route", "to.*").withColumn("kind", F.lit("structural"))
    out = [F.col("from_layer").alias("layer"), "uuid", F.col("from_n").alias("n"), "route", "file", "first_line", "last_line", "content"]
    whole = dest.filter("anchor_name is null").join(sources.select("layer", "file", F.col("text").alias("content")), ["layer", "file"])
    whole = whole.withColumns({"first_line": F.lit(1), "last_line": F.size(F.split("content", "\n"))}).select(*out)
    ident = F.concat_ws("@", "uuid", "from_layer", F.col("from_n").cast("string"))
    found = subrange_slice(anchor_resolve(dest, fragments)).filter("node_start is not null").select("from_layer", "uuid", "from_n", "route", "layer", "file", ident.alias("id"), F.col("frag_start").alias("start"), F.col("frag_end").alias("end"))
    got = fragment_get(found.select("layer", "file", "id", "start", "end"), line_offsets(sources), before, after)
    part = found.drop("layer", "start", "end").join(got, "id").select(*out)
    return whole.unionByName(part)


def fragment_label(fragments: DataFrame) -> DataFrame:
    """fragments (file, query, start, end, text) with a label: file, first six words of the query, span, first and last line with text."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    w = F.array_remove(F.split("query", " +"), "")
    short = F.concat(F.array_join(F.slice(w, 1, 6), " "), F.when(F.size(w) > 6, "…").otherwise(""))
    first, last = F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(-1))
    body = F.when(F.size(lines) == 0, F.lit(None).cast("string")).when(first == last, first).otherwise(F.concat_ws(r"\l", first, F.lit("…"), last))
    span = F.concat(F.lit("bytes "), F.col("start").cast("string"), F.lit("~"), F.col("end").cast("string"))
    return fragments.withColumn("label", F.concat(F.replace(F.concat_ws(r"\l", "file", short, span, body), F.lit('"'), F.lit("'")), F.lit(r"\l")))


def first_of(candidates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key by an order."""
    return candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")
