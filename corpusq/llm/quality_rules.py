"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule. Policies are masks with a version name; applying
or comparing them, or asking what each rule costs, is bitwise work on the
ledger and never reads a text again.

Null and empty texts have no words and fail `few_words`. Repeated rows get one ledger row
each. An empty table gives an empty ledger. Extra columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import let, one_space, text_or_empty, without

SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_upper",
    "n_adjacent",
)


@dataclass(frozen=True)
class Rule:
    """A bit and the SQL condition on measurements under which a document fails."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 2 * n_words"),
    Rule("exclamations", 3, "10 * n_exclamations > 2 * n_words"),
    Rule("upper_case", 4, "10 * n_upper > 4 * word_chars"),
    Rule("word_length_low", 5, "word_chars < 2 * n_words"),
    Rule("word_length_high", 6, "word_chars > 20 * n_words"),
    Rule("adjacent_repeats", 7, "10 * n_adjacent > 3 * n_words"),
    Rule("duplicate_lines", 8, "n_lines >= 10 and 10 * n_dup_lines > 5 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A named version: the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
STRICT = Policy(
    "prose-1",
    (*BASE.rules, "symbols", "exclamations", "upper_case", "word_length_low", "word_length_high", "adjacent_repeats",
     "duplicate_lines"),
)


def _repeated(hashes: Column) -> Column:
    """Words covered by a window that occurs at least twice, from the windows' hashes.

    Windows are sorted with their places, those equal to a neighbour are kept, and the
    lengths between kept places are summed: n log n in one row, whatever the text repeats.
    """

    def covered(s: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(s) - 1)
        h = lambda i: F.get(s, i)["h"]
        twice = F.filter(index, lambda i: F.coalesce(h(i) == h(i - 1), F.lit(False)) | F.coalesce(h(i) == h(i + 1), F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda i: F.get(s, i)["p"])), lengths)

    def lengths(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, let(placed, covered)).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keys` and the measurements of every whole text, all row by row: nothing is shuffled.

    Window equality is equality of 64-bit hashes inside one text: hashes of two, four, then eight words,
    each made from two of the level before.
    """
    own = docs.select(*keys, text_or_empty(F.col(text)).alias("_t"))
    spaced = own.select(*keys, "_t", one_space(F.col("_t")).alias("_s"))
    cut = spaced.select(
        *keys,
        F.char_length(without(F.col("_s"), " ")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_exclamations"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.filter(F.split("_t", "\n"), lambda x: without(one_space(x), " ") != "").alias("_lines"),
        F.array_remove(F.split("_s", " "), "").alias("_w"),
    )

    def joined(level: str, step: int) -> Column:
        return F.transform(level, lambda x, i: F.xxhash64(x, F.get(F.col(level), i + step)))

    counted = cut.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_adjacent": F.size(F.filter("_w", lambda w, i: F.coalesce(w == F.get("_w", i - 1), F.lit(False)))).cast("long"),
        "_h": joined("_w", 1),
    })
    for step in (2, 4):
        counted = counted.withColumn("_h", joined("_h", step))
    whole = F.slice("_h", F.lit(1), F.greatest(F.lit(0), F.size("_h") - (WINDOW - 1)))
    windows = counted.withColumn("_h", whole)
    # never null; a value that names a row number is not copied into filters above, where it would be computed per mention
    once = F.when(F.monotonically_increasing_id() >= 0, _repeated(F.col("_h")))
    return windows.withColumn("n_repeat_words", once).select(*keys, *MEASURES)


def ledger(
    docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Measurements and `failures`, the bits of all failed rules."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, text, keys).withColumn("failures", total)


def passes(policy: Policy, failures: str = "failures", rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col(failures).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policies(held: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One boolean column per policy version, true where the document stays."""
    return held.withColumns({p.version: passes(p, rules=rules) for p in policies})


def ablations(held: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of a policy costs: documents failing it, failing only it, and kept without it.

    One pass and one combined aggregation over the masks (a few counts per task).
    """
    mask = F.lit(policy.mask(rules)).cast("long")
    masked = F.col("failures").bitwiseAND(mask)
    chosen = [r for r in rules if r.name in policy.rules]
    counts = held.agg(
        F.count("*").alias("documents"), F.count_if(masked == 0).alias("kept"),
        F.bit_or(masked).alias("ever"), F.bit_and(masked).alias("always"),
        *[F.count_if(masked.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f_{r.name}") for r in chosen],
        *[F.count_if(masked == F.lit(1 << r.bit)).alias(f"o_{r.name}") for r in chosen],
    )
    cells = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"), F.col(f"f_{r.name}").alias("failed"),
            F.col(f"o_{r.name}").alias("only_this"), (F.col("kept") + F.col(f"o_{r.name}")).alias("kept_without"),
            (F.coalesce(F.col("ever"), F.lit(0)).bitwiseAND(F.lit(1 << r.bit)) != 0).alias("ever_failed"),
        )
        for r in chosen
    ])
    return counts.select("documents", "kept", F.explode(cells).alias("r")).select(
        F.lit(policy.version).alias("version"), "documents", "kept", "r.*"
    )


def keep(docs: DataFrame, policy: Policy = STRICT, text: str = "text") -> DataFrame:
    """The rows of `docs`, whole and with their own columns, that the policy keeps."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    held = ledger(row.select("_row", F.col(f"_row.{text}").alias("_text")), "_text", ("_row",))
    return held.where(passes(policy)).select("_row.*")
