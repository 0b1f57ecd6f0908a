"""Spelling variants: words one edit apart, found among the sorted rotations of all words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.llm.frames import stored

# A word of a text, and the mark of its end among its rotations, which is no letter.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
END = "$"
# A word with more than twice the occurrences of a near one is taken to be meant.
RATIO = 2
# Where this divides the CRC-32 of `<doc_id>:<run>`, the run loses a code point.
PLANT = 97


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3, plant: int | None = PLANT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of all texts with so many code points and occurrences.

    With `plant`, a fixed share of the runs loses one code point: misspellings at
    known places. A null text has no runs, a null id counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", lower(F.col("run")).alias("run"))
    word = F.col("run")
    if plant:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        place = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
        word = F.when(h % plant == 0, cut).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, edited, first, word, n): for every rotation of word + END which of
    its prefixes it shares with near words.

    The rotation that begins behind a code point ends with it; without it, it is
    a prefix that the words with another code point at this place share. The
    whole rotation of a word is such a prefix of the words that have one code
    point more there (`edited` is null then). `first` is false behind the
    second and further of equal code points in a row: leaving out any of them
    gives the same word, which counts once.
    """
    rest = lambda i: F.expr(f"substr(word, {i} + 1)")
    at = words.withColumn("m", F.length("word")).withColumn("i", F.explode(F.expr("sequence(0, length(word))")))
    c = F.expr("substr(word, i, 1)")
    skipping = F.struct(
        F.concat(rest("i"), F.lit(END), F.expr("substr(word, 1, i - 1)")).alias("prefix"), c.alias("edited"),
        (F.expr("i = 1 OR substr(word, i, 1) <> substr(word, i - 1, 1)")).alias("first"))
    whole = F.struct(F.concat(rest("i"), F.lit(END), F.expr("substr(word, 1, i)")).alias("prefix"), F.lit(None).cast("string").alias("edited"), F.lit(True).alias("first"))
    both = F.when(F.col("i") > 0, F.array(whole, skipping)).otherwise(F.array(whole))
    return at.select(F.explode(both).alias("r"), "word", "n").select("r.prefix", "r.edited", "r.first", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words that have near ones: how many, and of these
    the struct (-n, word) with the largest n, ties by code-point order.

    The rotations are sorted over all tasks; what shares a prefix lies together:
    at most one word per letter of the alphabet, and one that is shorter. Each
    member gets its number of near words there and the best of the others, so no
    pair is ever written. Two words meet at one prefix only.
    """
    rows = rotations(words).withColumn("m", F.struct((-F.col("n")).alias("k"), "word", "edited", "first"))
    scan = rows.repartitionByRange("prefix").sortWithinPartitions("prefix", "edited")
    groups = scan.groupBy("prefix").agg(F.sort_array(F.collect_list("m")).alias("all")).where(F.size("all") > 1)
    members = groups.select(F.explode("all").alias("me"), "all")
    long_ones = F.filter("all", lambda o: o["edited"].isNotNull() & (o["word"] != F.col("me.word")))
    short = F.filter("all", lambda o: o["edited"].isNull())
    near = F.when(F.col("me.edited").isNull(), F.filter("all", lambda o: o["edited"].isNotNull() & o["first"])) \
        .when(F.col("me.first"), F.concat(long_ones, short)).otherwise(long_ones)
    met = members.select("me.word", near.alias("near")).where(F.size("near") > 0)
    best = F.array_min(F.transform("near", lambda o: F.struct(o["k"].alias("k"), o["word"].alias("word"))))
    return met.select("word", F.size("near").alias("c"), best.alias("best")).groupBy("word").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends, for words that have a form.
    The steps double in each round, so a chain of any length takes its logarithm."""
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        ends = stored(ends, "roots")
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = ends.join(on, "root", "left")
        if further.where("next IS NOT NULL").isEmpty():
            return ends
        ends = further.select("word", F.coalesce("next", "root").alias("root"))


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of (word, n).

    Two words are near if they differ by one inserted, deleted or replaced code
    point. `form` is the near word of largest n (ties: smallest in code-point
    order) if that n is at least `ratio` times the word's own; n grows along the
    forms, so they end, at `root`. Words must be distinct and must not hold the
    END mark; rows with a null word are left out. No word, no rows; other
    columns are ignored.
    """
    if ratio < 2:
        raise ValueError("forms only end if ratio is 2 or more")
    words = stored(words.where("word IS NOT NULL").select("word", "n"), "words")
    near = neighbours(words)
    found = words.join(near, "word", "left")
    good = -F.col("best.k") >= ratio * F.col("n")
    formed = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.k")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
