"""Quality rules: a threshold table compiled into projections of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages.
STOP_WORDS = tuple(dict.fromkeys((
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son elle ou mais comme sa été nous aux cette leur y même on ses deux tout "
    "el que y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque").split()))


class Rule(NamedTuple):
    """A document passes when low <= metric <= high; a null bound is open."""

    name: str
    metric: str
    low: float | None
    high: float | None


RULES = (
    Rule("long_enough", "n_words", 10, None),
    Rule("few_repeats", "repeat_percent", None, 20),
    Rule("word_length", "mean_word_chars", 2, 15),
    Rule("few_symbols", "symbols_per_word", None, 0.2),
    Rule("stop_words", "stop_share", 0.02, None),
    Rule("few_repeated_lines", "dup_line_share", None, 0.3),
)
BASE = ("long_enough", "few_repeats")

_SPACE = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"
_SYMBOLS = "#*$%&|<>"


def measure(docs: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Adds the metrics of the rules under names starting with `_q_`.

    A null text has no words. All ratios of a text without words or lines are 0.
    Repeated windows are found by 64-bit hashes first; texts in which one occurs
    twice are counted again on the windows themselves, so the count is exact.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select("*", t.alias("_q_text"))
    out = out.select("*", F.expr(f"filter(split(_q_text, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> '')").alias("_q_words"),
                     F.expr(f"filter(split(_q_text, '\\\\n'), l -> btrim(l, '{_SPACE}') <> '')").alias("_q_lines"))
    out = out.select("*", F.size("_q_words").cast("long").alias("_q_n_words"),
                     F.expr(f"cast(length(translate(_q_text, '{_SPACE}', '')) as bigint)").alias("_q_word_chars"),
                     F.expr(f"cast(length(_q_text) - length(translate(_q_text, '{_SYMBOLS}', '')) as bigint)").alias("_q_n_symbols"),
                     F.size("_q_lines").cast("long").alias("_q_n_lines"),
                     F.expr("cast(size(_q_lines) - size(array_distinct(_q_lines)) as bigint)").alias("_q_n_dup_lines"),
                     F.size(F.filter("_q_words", lambda w: w.isin(*stop_words))).cast("long").alias("_q_n_stop"),
                     F.expr("""if(size(_q_words) < 5, cast(array() as array<bigint>), transform(sequence(0, size(_q_words) - 5),
                               i -> xxhash64(_q_words[i], _q_words[i + 1], _q_words[i + 2], _q_words[i + 3], _q_words[i + 4])))""").alias("_q_hashes"))
    # windows in order of their words, only where some hash occurs twice
    out = out.select("*", F.expr("""if(size(array_distinct(_q_hashes)) = size(_q_hashes), cast(array() as array<struct<s:string,i:int>>),
                     array_sort(transform(sequence(0, size(_q_words) - 5), i -> struct(array_join(slice(_q_words, i + 1, 5), ' ') as s, i as i))))""").alias("_q_windows"))
    out = out.select("*", F.expr("""array_sort(transform(filter(transform(_q_windows, (w, k) ->
                     struct(w.i as i, (get(_q_windows, k - 1).s <=> w.s) or (get(_q_windows, k + 1).s <=> w.s) as twice)), w -> w.twice), w -> w.i))""").alias("_q_at"))
    out = out.select("*", F.expr("""cast(aggregate(_q_at, struct(0 as until, 0 as n),
                     (a, p) -> struct(p + 5 as until, a.n + 5 - greatest(0, a.until - p) as n)).n as bigint)""").alias("_q_n_repeat_words"))
    n = F.col("_q_n_words")

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    metrics = [F.col(f"_q_{c}") for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop", "n_repeat_words")]
    metrics += [(100 * ratio("_q_n_repeat_words", "_q_n_words")).alias("_q_repeat_percent"), ratio("_q_word_chars", "_q_n_words").alias("_q_mean_word_chars"), ratio("_q_n_symbols", "_q_n_words").alias("_q_symbols_per_word"),
                ratio("_q_n_stop", "_q_n_words").alias("_q_stop_share"), ratio("_q_n_dup_lines", "_q_n_lines").alias("_q_dup_line_share")]
    # one row each again: a filter on metrics stays above this, instead of computing them several times
    return out.select(*docs.columns, F.inline(F.array(F.struct(*metrics))))


def fails(rule: Rule) -> Column:
    """True when the measured document breaks the rule. The two rules of the base
    compare whole numbers, the others ratios."""
    if rule.metric == "repeat_percent":
        return 100 * F.col("_q_n_repeat_words") > rule.high * F.col("_q_n_words")
    m = F.col(f"_q_{rule.metric}")
    parts = ([m < rule.low] if rule.low is not None else []) + ([m > rule.high] if rule.high is not None else [])
    bad = F.lit(False)
    for p in parts:
        bad = bad | p
    return bad


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[str] = BASE, text: str = "text",
          stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Adds metrics (`_q_*`), `failed_rules` (names, in table order), `base_failed`
    and `kept` to the documents; existing columns of these names are replaced.

    Null and empty texts break the length rule. Repeated rows are judged each by
    itself, and an empty table gives an empty result.
    """
    clash = [c for c in docs.columns if c.startswith("_q_") or c in ("failed_rules", "base_failed", "kept")]
    out = measure(docs.drop(*clash), text, stop_words)
    failed = F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]) if rules else F.array().cast("array<string>"), lambda x: x.isNotNull())
    hard = [fails(r) for r in rules if r.name in base]
    base_failed = F.lit(False)
    for h in hard:
        base_failed = base_failed | h
    return out.select("*", failed.alias("failed_rules"), base_failed.alias("base_failed")).withColumn("kept", F.size("failed_rules") == 0)
