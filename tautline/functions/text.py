"""Text expressions: digests, shapes, byte offsets, identifiers, layer paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def shape(text: Column, mode: str = "shape") -> Column:
    """What formatting and wording leave of a text: runs of letters become w, of digits n, white space goes.
    mode 'whitespace' drops white space only."""
    if mode == "shape":
        text = F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "w"), "[0-9]+", "n")
    return F.regexp_replace(text, r"[ \t\r\n]+", "")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end (exclusive, from 0) of the UTF-8 form, as text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def link_id(*parts: Column) -> Column:
    """A UUID-shaped identifier that follows from a natural key."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def language(file: Column) -> Column:
    """Language by file extension; unknown ones are text."""
    ext = F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1)
    return F.when(ext == "html", "html").when(ext == "java", "java").when(ext == "rs", "rust").when(ext == "md", "markdown").otherwise("text")


def layer_depth(layer: Column) -> Column:
    """How many layers deep a layer path is nested."""
    return (F.size(F.split(layer, r"\.stratum/")) - 1).cast("int")


def turn_layer(turn: Column) -> Column:
    """The nested layer of a conversation's turn; turn 0 is the root layer."""
    path = F.array_join(F.transform(F.sequence(F.lit(1), turn.cast("int")), lambda t: F.concat(F.lit(".stratum/t"), t.cast("string"))), "/")
    return F.when(turn == 0, ".").otherwise(path)


def relative_layer(from_layer: Column, to_layer: Column) -> Column:
    """Pointer from one layer to another on the same branch: '<' for each step up, '>name' for each step down."""
    parts = lambda c: F.array_remove(F.split(F.regexp_replace(F.when(c == ".", "").otherwise(c), r"\.stratum/", ""), "/"), "")
    a, b = parts(from_layer), parts(to_layer)
    same = F.aggregate(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), F.lit(0), lambda acc, i: F.when((i > 0) & (acc == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(acc))
    up = F.array_join(F.array_repeat(F.lit("<"), F.size(a) - same), "")
    down = F.array_join(F.transform(F.slice(b, same + 1, F.size(b)), lambda x: F.concat(F.lit(">"), x)), "")
    return F.concat(up, down)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def running_starts(sizes: Column) -> Column:
    """The sum of the sizes before each element of an array: each of log2(n) passes adds to every sum the one that ends 1, 2, 4, ... places before it. Some
    n * log2(n) additions within the row, without a shuffle."""

    def of(x: Column) -> Column:
        passes = F.greatest(F.ceil(F.log2(F.greatest(F.size(x), F.lit(2)))), F.lit(1)).cast("int")
        double = lambda acc, k: let(F.call_function("shiftleft", F.lit(1), k), lambda s: F.transform(acc, lambda v, i: F.when(i >= s, v + F.get(acc, i - s)).otherwise(v)))
        sums = F.aggregate(F.sequence(F.lit(0), passes - 1), F.transform(x, lambda v: v.cast("long")), double)
        return F.zip_with(sums, x, lambda total, v: total - v)

    return let(sizes, of)
