"""Quality rules as a bitmask ledger; DataFrame operations only.

Every rule is evaluated once per document.  The ledger holds the measurements
and one failure bit per rule.  Policies are versioned masks over those bits: a
verdict, a new policy or an ablation reads the ledger and never the texts again.

A word of a 3-word window that occurs at least twice in the text counts as
repeated.  Windows are first told apart by a 33-bit hash packed with the position
into one long per window, so that a primitive sort finds the few windows whose
hash repeats; those alone are compared as strings.

Defined cases: null and empty text have no words and fail the base rules; a null
id stays null; repeated rows give repeated ledger rows; an empty table gives an
empty ledger; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACES, WORD, id_text
from strandline.scratch import materialise

#: name -> failing condition over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "100 * n_capitals > 60 * word_chars",
}
BASE = ("few_words", "repeated_words")
#: version -> rules that a document must pass.
POLICIES: dict[str, tuple[str, ...]] = {"base-1": BASE, "lines-1": (*BASE, "duplicate_lines"), "full-1": tuple(RULES)}
PRODUCTION = "full-1"
_LOW = 31


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def _windows(w: F.Column, n: F.Column) -> F.Column:
    """One long per 3-word window: hash above, position below."""
    one = lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _LOW).bitwiseOR(i.cast("long"))
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), one)).otherwise(F.array().cast("array<bigint>"))


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (long)."""
    text, w, s, c = F.col("text"), F.col("w"), F.col("s"), F.col("c")
    high = lambda x: F.shiftrightunsigned(x, _LOW)
    near = lambda a, key: lambda x, j: (key(x) == key(F.get(a, j - 1))) | (key(x) == key(F.get(a, j + 1)))
    words = lambda p: F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    out = docs.select("doc_id", "text", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), lines.alias("l"))
    out = out.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    plain = [x for x in out.columns if x != "w"]
    out = out.select(*plain, "w", F.sort_array(_windows(w, F.size(w))).alias("s"))
    again = F.transform(F.filter(s, near(s, high)), lambda x: x.bitwiseAND(F.lit((1 << _LOW) - 1)).cast("int"))
    out = out.select(*plain, F.array_sort(F.transform(again, lambda p: F.struct(words(p).alias("t"), p.alias("p")))).alias("c"))
    out = out.select(*plain, F.sort_array(F.transform(F.filter(c, near(c, lambda x: x["t"])), lambda x: x["p"])).alias("p"))
    p = F.col("p")
    fresh = F.transform(p, lambda x, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, j - 1))).cast("long"))
    return out.select(*plain, F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``fail_bits`` (long), each rule evaluated once.

    Store it before filtering by a measurement: Catalyst would otherwise repeat
    the whole expression inside the filter.
    """
    bits = F.lit(0).cast("long")
    for rule, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return measurements(id_text(docs, id_col, text_col)).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: str) -> F.Column:
    """Whether a ledger row passes every rule of the policy."""
    return rows["fail_bits"].bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy costs: rule, failed, failed_alone, kept_without.

    The ledger is first counted by its bit pattern (at most 2^rules rows); the
    rest is bit arithmetic over those patterns.
    """
    rules = POLICIES[policy]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in rules]))
    b, one = F.col("bits"), F.col("bit").cast("long")
    return (
        patterns.select("bits", "n", each.alias("r"))
        .select("bits", "n", "r.*")
        .groupBy("rule")
        .agg(total(b.bitwiseAND(one) != 0).alias("failed"), total(b == one).alias("failed_alone"), total(b.bitwiseOR(one) == one).alias("kept_without"))
    )


def judged(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Write the ledger, read it back, and apply the base rules and ``policy``."""
    rows = materialise(ledger(docs), "ledger")
    base = rows["fail_bits"].bitwiseAND(F.lit(mask("base-1"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & apply_policy(rows, policy)).alias("kept"), "fail_bits", "n_lines", "n_capitals")
