"""Secret scans with multipart linking (DataFrame functions only).

Strong parts are always reported: assigned values, access identifiers, long hexadecimal runs. Weak parts (user and
client identifiers, mixed random-looking strings, endpoints) are common in clean text, so they are
reported only where complementary parts stand within `SCOPE` characters in the same document:
a weak secret beside an identifier or endpoint, a weak identifier beside a secret, an endpoint beside both.

Positions come from the texts between matches: a document's parts are rows, and a running sum of lengths gives each
start. Two parts are linked if at most `SCOPE` characters stand between the end of one and the start of the other. The
interval join is two running frames for each role: the largest end so far and the smallest start to come. No pairs are built.

Null and empty texts have no parts. Null ids and repeated rows give one result row each. An empty table gives an
empty result. Extra columns are passed over (`find`) or kept (`redact`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import let
from corpusq.session import join_small, materialize

SCOPE = 200
MARK = "[removed]"
_PIECE = 1_024  # characters of the pieces that a text is cut into before stretches are taken out

# The three strong kinds, in the order of results.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

# Weak kinds.
NAMED = r"""(?i:client_?id|account_?id|access_?key(?:_?id)?|user_?(?:name|id)|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+"""
MIXED = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

STRONG = ("assign", "access", "hex")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
KINDS = tuple(ROLE)


def _matches(text: Column, kind: str, pattern: str, value_group: int = 0, may: Column | None = None) -> Column:
    """Places of all leftmost non-overlapping matches: `(kind, k, before, size, value)`, `before` being the length of the text
    since the last match and `value` the matched group. Texts without a match are searched once only."""
    p = F.lit(pattern)
    before = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(value_group)) if value_group else whole
    rows = F.transform(
        F.arrays_zip(F.slice(before, F.lit(1), F.size(before) - 1).alias("b"), whole.alias("w"), value.alias("v")),
        lambda x, k: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), k.alias("k"), x["b"].alias("before"),
            F.char_length(x["w"]).alias("size"), x["v"].alias("value"),
        ),
    )
    found = F.regexp_like(text, p) if may is None else may & F.regexp_like(text, p)
    return F.when(found, rows).otherwise(F.array().cast(_PARTS))


_PARTS = "array<struct<kind:int,k:int,before:int,size:int,value:string>>"


def parts(text: Column) -> Column:
    """All candidate parts of a text as one array, in no particular order. A run of {32,} hexadecimal digits is the
    same as a maximal run that is long enough, so short runs (most of any text) never become rows."""
    return F.concat(
        _matches(text, "assign", ASSIGN, 2),
        _matches(text, "access", ACCESS.replace("+", f"{{{ACCESS_LEAST - 4},}}"), may=F.contains(text, F.lit("AKIA"))),
        _matches(text, "hex", HEX.replace("+", f"{{{HEX_LEAST},}}")),
        _matches(text, "weak_id", NAMED),
        _matches(text, "weak_secret", MIXED),
        _matches(text, "endpoint", ENDPOINT, may=F.contains(text, F.lit("://"))),
    )


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    """From part rows `(_row, kind, k, before, size, value, ...)`: `start`, `end` and `reported`."""
    order = Window.partitionBy("_row", "kind").orderBy("k")
    placed = rows.withColumn("end", F.sum(F.col("before") + F.col("size")).over(order).cast("long"))
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    kind, value = F.col("kind"), F.col("value")
    code = {k: n for n, k in enumerate(KINDS)}
    valid = (
        F.when(kind == code["assign"], F.char_length(value) >= ASSIGN_LEAST)
        .when(kind == code["weak_secret"], value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]"))
        .otherwise(True)
    )
    placed = placed.withColumn("kind", F.when(valid, kind))  # parts that fail stay as empty rows
    strong = kind < len(STRONG)
    before = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.coalesce(F.max(F.when(strong, F.col("end"))).over(before) > F.col("start"), F.lit(False))
    so_far = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def beside(role: str) -> Column:
        held = kind.isin([code[k] for k, r in ROLE.items() if r == role])
        earlier = F.max(F.when(held, F.col("end"))).over(so_far) >= F.col("start") - scope
        later = F.min(F.when(held, F.col("start"))).over(to_come) <= F.col("end") + scope
        return F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))

    linked = (
        F.when(kind == code["weak_id"], beside("secret"))
        .when(kind == code["weak_secret"], beside("id") | beside("endpoint"))
        .otherwise(beside("id") & beside("secret"))
    )
    return placed.withColumns({"reported": kind.isNotNull() & (strong | (linked & ~covered))})


def _spans(rows: DataFrame, scope: int, *carried: str) -> DataFrame:
    """One row per document row: its reported spans `(start, kind, end, reach)` in order, `reach` being the end of all text
    that earlier spans cover."""
    earlier = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(F.col("reported"), F.col("end"))).over(earlier), F.lit(0))
    span = F.struct("start", "kind", "end", "reach")
    return _linked(rows, scope).withColumn("reach", reach).groupBy("_row").agg(
        *[F.first(c).alias(c) for c in carried], F.sort_array(F.collect_list(F.when(F.col("reported"), span))).alias("spans")
    )


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row of `docs`: doc_id, counts of the strong kinds, digest of the strong spans, all spans.

    Texts are searched where they lie; only the parts (and one empty row for each document) are shuffled, once.
    """
    own = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    found = own.select(F.monotonically_increasing_id().alias("_row"), "doc_id", parts(F.col("_t")).alias("_parts"))
    rows = found.select("_row", "doc_id", F.inline_outer("_parts"))
    spans = _spans(rows, scope, "doc_id")
    strong = F.filter("spans", lambda s: s["kind"] < len(STRONG))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(STRONG)]
    return spans.select("doc_id", *counts, F.sha2(_named(strong), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with its spans replaced by `mark`; spans that overlap give one mark. The text is first cut into pieces of equal
    length in one pass, so that taking out a stretch costs its own length, not its place."""

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / F.lit(_PIECE)).cast("int")
        last = F.floor((b - 1) / F.lit(_PIECE)).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(some, (a - first * _PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def rebuilt(pieces: Column) -> Column:
        kept = F.transform(
            spans, lambda s: F.when(s["start"] >= s["reach"], F.concat(cut(pieces, s["reach"], s["start"]), F.lit(mark))).otherwise("")
        )
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), cut(pieces, end, F.char_length(text).cast("long")))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), rebuilt)


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mark: str = MARK, length: str | None = "n_chars") -> DataFrame:
    """All rows of `docs` with their columns; reported spans of the text are replaced by `mark`.

    `length`, if such a column exists, is set to the new number of characters where the text changed. Documents without parts are
    not moved: only the spans of the others are joined back, to a stored copy in which rows are numbered.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_r"))
    own = F.coalesce(F.col(f"_r.{text}"), F.lit(""))
    held = materialize(row.select("_r", F.monotonically_increasing_id().alias("_row"), parts(own).alias("_parts")), "scanned")
    some = held.where(F.size("_parts") > 0).select("_row", F.inline("_parts"))
    spans = _spans(some, scope).where(F.size("spans") > 0)
    back = join_small(held.select("_row", "_r"), materialize(spans, "spans"), "_row", "left")
    changed = F.when(F.col("spans").isNull(), F.col(f"_r.{text}")).otherwise(_without(own, F.col("spans"), mark))
    out = back.withColumn("_new", changed)
    columns = []
    for c in names:
        if c == text:
            columns.append(F.col("_new").alias(c))
        elif c == length:
            kind = docs.schema[c].dataType
            columns.append(F.when(F.col("spans").isNull(), F.col(f"_r.`{c}`")).otherwise(F.char_length("_new").cast(kind)).alias(c))
        else:
            columns.append(F.col(f"_r.`{c}`").alias(c))
    return out.select(*columns)
