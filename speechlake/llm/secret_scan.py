r"""Operator 8: secret scan with multipart credential linking, in DataFrame functions only.

Base findings (assign, access, hex) stand alone. Weak candidates don't: an identifier (``client_id = ..``, or the like), an
opaque string (32 or more base64 characters, cases and digits mixed) and an endpoint (a URL or database address) become
findings only where they complete a credential: within ``SCOPE`` characters of the same text, an identifier needs a secret,
an opaque string needs an identifier, and an endpoint needs both. Parts are rows (text, kind, start, end); the interval
join meets them by text and scope cell, each part in all cells from its start to its end, so pairs are found whatever their
lengths and offsets. The disjoint spans of a cell are at most a few dozen, so no text or cell gets hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, let, materialize

#: Patterns of the base kinds, and the least length of the group that decides.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Patterns of the weak kinds.
IDENT = r"""(?i:access|client|account|app|user)_?(?i:key_?)?(?i:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
OPAQUE = r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+"

KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
SCOPE = 400


def matches(text: Column, pattern: str) -> Column:
    """Spans (start, end) of the leftmost non-overlapping matches, in code points: what lies between them gives the starts."""
    span = lambda a, m: F.struct(a.cast("int").alias("start"), (a + m).cast("int").alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))
        pairs = F.zip_with(F.transform(found, lambda x: F.length(x)), F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(g.alias("g"), m.alias("m")))
        return let(pairs, lambda p: F.zip_with(p, before(F.transform(p, lambda x: (x["g"] + x["m"]).cast("long"))), lambda x, b: span(b + x["g"], x["m"])))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def assigned(text: Column) -> Column:
    """Spans of assignments whose value has 12 characters or more; shorter ones are passed over but still consumed."""

    def long_enough(spans: Column) -> Column:
        paired = F.zip_with(spans, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda s, v: F.struct(s.alias("s"), (F.length(v) >= 12).alias("ok")))
        return F.transform(F.filter(paired, lambda x: x["ok"]), lambda x: x["s"])

    return let(matches(text, ASSIGN), lambda spans: F.when(F.size(spans) > 0, long_enough(spans)).otherwise(spans))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _listing(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base array, added array (spans as (start, kind, end)) for each row of (doc_id, text).

    Null text counts as empty. Rows with the same doc_id, equal rows and null numbers are scanned each on their own. A weak
    candidate that touches a base finding is part of it and isn't added. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    t = docs.select("doc_id", text.alias("t")).withColumns({"a": assigned(F.col("t")), "k": matches(F.col("t"), ACCESS), "h": matches(F.col("t"), HEX)})
    weak = F.concat(_tagged(matches(F.col("t"), IDENT), 3), _tagged(matches(F.col("t"), OPAQUE), 4), _tagged(matches(F.col("t"), ENDPOINT), 5))
    t = t.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *(F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))),
        F.concat(_tagged(F.col("a"), 0), _tagged(F.col("k"), 1), _tagged(F.col("h"), 2)).alias("base"), weak.alias("weak"),
    )
    t = materialize(t, "secrets")
    parts = t.where(F.size("weak") > 0).select("row", F.inline(F.concat("base", "weak")))
    first, last = (F.floor(F.col(c) / SCOPE).cast("int") for c in ("start", "end"))
    # a part is in all cells that it spans, and the other side in one more at each end; pairs may meet several times
    a = parts.where("kind >= 3").withColumn("cell", F.explode(F.sequence(first, last))).alias("a")
    b = parts.withColumn("cell", F.explode(F.sequence(first - 1, last + 1))).alias("b")
    meet = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.cell") == F.col("b.cell")))
    gap = F.greatest(F.col("a.start"), F.col("b.start")) - F.least(F.col("a.end"), F.col("b.end"))
    base_hit = (gap < 0) & (F.col("b.kind") < 3)
    apart = (gap >= 0) & (gap <= SCOPE)
    has = lambda c: F.max(c.cast("int"))
    meet = meet.groupBy(*(F.col(f"a.{c}").alias(c) for c in ("row", "start", "kind", "end"))).agg(
        has(base_hit).alias("taken"), has(apart & F.col("b.kind").isin(1, 3)).alias("ident"), has(apart & F.col("b.kind").isin(0, 2)).alias("secret"), has(apart & (F.col("b.kind") == 4)).alias("opaque")
    )
    some = (F.col("secret") == 1) | (F.col("opaque") == 1)
    linked = meet.where((F.col("taken") == 0) & F.when(F.col("kind") == 3, some).when(F.col("kind") == 4, F.col("ident") == 1).otherwise((F.col("ident") == 1) & some))
    added = linked.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return t.join(added, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce("added", empty).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 of the base spans' listing, spans: the listing of all, by start and kind."""
    return scan(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(F.concat("base", "added")).alias("spans")
    )
