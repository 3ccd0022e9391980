"""Finding members that are stored as JSON text, read into the structures of saved findings.

Text of several shapes is accepted: a flow end may be an object or just its kind; a path step may be an object or just a file; a lone
object stands for an array of one; a flow in an array of one stands for itself; JSON text inside a JSON string is read, however
often it was wrapped. Absent members and JSON nulls are null. Text that is not one complete JSON value gives null.

Each level is read by Spark's own JSON reader in the JVM with members kept as raw text, so one member may hold values of several
shapes: a member's text that is a JSON object or array is read as such, any other (``[slug].tsx``, ``{id}.ts``) is the plain value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesift.functions.binding import let

STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
LOCATION = "struct<file:string,line:int,column:int>"
NODE = f"struct<kind:string,label:string,location:{LOCATION}>"
FLOW = f"struct<source:{NODE},sink:{NODE},path:array<{LOCATION}>>"
MAPPING = "struct<framework:string,article:string,title:string,risk_description:string,recommendation:string>"


def strict_json(text: Column) -> Column:
    """The raw text (of a JSON string: its content) of the one JSON value a text consists of, else null."""
    # The reader stops after the first value; wrapped as the sole element of an array the text has to fill it alone.
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
    return let(listed, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))


def _starts(text: Column, mark: str) -> Column:
    return F.ltrim(text).startswith(mark)


def _between(text: Column, opening: str, closing: str) -> Column:
    return F.ltrim(text).startswith(opening) & F.rtrim(text).endswith(closing)


def unwrapped(text: Column) -> Column:
    """``strict_json``, JSON strings that hold JSON text read in turn.

    Each wrap escapes the quotes and backslashes of the last, so a text is wrapped no more often than the logarithm of its length says.
    """

    def unwrap(v: Column) -> Column:
        most = F.sequence(F.lit(0), F.ceil(F.log2(F.length(v))).cast("int"))
        inner = F.aggregate(most, v, lambda x, _: F.when(_starts(x, '"'), strict_json(x)).otherwise(x))
        return F.when(_starts(v, '"'), inner).otherwise(v)

    return let(let(text, unwrap), strict_json)


def _location(v: Column) -> Column:
    def read(x: Column) -> Column:
        none = F.lit(None).cast("int")
        plain = F.struct(x.alias("file"), none.alias("line"), none.alias("column"))
        empty = lambda p: p["file"].isNull() & p["line"].isNull() & p["column"].isNull() & strict_json(x).isNull()
        full = let(F.from_json(x, LOCATION, STRICT), lambda p: F.when(~empty(p), p).otherwise(plain))
        return F.when(_between(x, "{", "}"), full).when(x.isNotNull(), plain)

    return let(v, read)


def _node(v: Column) -> Column:
    def read(x: Column) -> Column:
        plain = F.struct(x.alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast(LOCATION).alias("location"))
        empty = lambda n: n["kind"].isNull() & n["label"].isNull() & n["location"].isNull() & strict_json(x).isNull()
        full = let(
            F.from_json(x, "struct<kind:string,label:string,location:string>", STRICT),
            lambda n: F.when(~empty(n), F.struct(n["kind"].alias("kind"), n["label"].alias("label"), _location(n["location"]).alias("location"))).otherwise(plain),
        )
        return F.when(_between(x, "{", "}"), full).when(x.isNotNull(), plain)

    return let(v, read)


def _elements(v: Column) -> Column:
    """An array of raw texts: the array's elements, or a lone value as an array of one."""

    def read(x: Column) -> Column:
        alone = F.when(x.isNotNull(), F.array(x))
        return F.when(_between(x, "[", "]"), F.coalesce(F.from_json(x, "array<string>", STRICT), alone)).otherwise(alone)

    return let(v, read)


def flow_of(text: Column) -> Column:
    """``data_flow`` text as the flow structure."""

    def read(parts: Column) -> Column:
        return F.struct(
            _node(parts["source"]).alias("source"),
            _node(parts["sink"]).alias("sink"),
            F.transform(_elements(parts["path"]), _location).alias("path"),
        )

    sole = let(_elements(unwrapped(text)), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))
    parts = let(sole, lambda x: F.when(_starts(x, "{"), F.from_json(x, "struct<source:string,sink:string,path:string>", STRICT)))
    return let(parts, lambda x: F.when(x.isNotNull(), read(x))).cast(FLOW)


def mappings_of(text: Column) -> Column:
    """``framework_mappings`` text as the array of mapping structures."""
    return F.transform(
        _elements(unwrapped(text)), lambda x: F.when(_starts(x, "{"), F.from_json(x, MAPPING, STRICT))
    ).cast(f"array<{MAPPING}>")
