"""Spelling variants by permuterm rotations.

Each word is marked with a terminator at its end, and all its rotations are sorted, over ranges of the rotations. Words that
differ in one letter have rotations that agree but for their last letter, where the edited letter has been turned to the end;
a word that lacks the letter has a whole rotation equal to the rest. So what is near meets under one prefix:

    tr-a-in -> in$tr|a      tr-u-in -> in$tr|u      trin -> in$tr

A scan of each such group counts the neighbours of every member and names the most frequent one. A group holds at most one
whole rotation and one rotation for each letter of the alphabet, so it is small whatever the table's size, and no pair of
words is ever written: a member needs only the group's counts and its two best rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.arrays import explode_once
from auditloom.llm.common import stored

# Letters of words: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
TERMINATOR = "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Longer prefixes are named by a digest, so that a word of thousands of letters does not write its square.
LONGEST_KEY = 64


def letter_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 7) -> DataFrame:
    """(id, run) for each maximal run of letters of at least ``least`` code points, A-Z lower-cased; null texts have none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = explode_once(docs, [F.col(id_col).cast("string").alias("id")], found, "run")
    return rows.withColumn("run", F.translate("run", UPPER, LOWER))


def lose_letters(runs: DataFrame, one_in: int) -> Column:
    """The run, or, if ``one_in`` divides the crc32 h of ``<id>:<run>``, the run without its code point h % length.

    A null id is written as ``null``.
    """
    run, size = F.col("run"), F.length("run")
    h = F.crc32(F.concat(F.coalesce("id", F.lit("null")), F.lit(":"), run).cast("binary"))
    at = (h % size).cast("int")
    return F.when(h % one_in == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, size))).otherwise(run)


def word_counts(words: DataFrame, *, least: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) of the words of at least ``least`` code points that occur ``min_count`` times or more."""
    counted = words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _rotations(words: DataFrame) -> DataFrame:
    """(id, n) -> two rows a rotation: whole (kind 1), and without the letter at its end (kind 0).

    ``first`` is true if the letter is not the one before it in the word: leaving out any letter of a double gives the
    same word, and only the first of them is to count.
    """
    size = F.length("word")
    turned = words.select("id", "n", "word", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    turned = turned.withColumn(
        "rotation", F.concat(F.col("word").substr(F.col("i") + 1, size), F.lit(TERMINATOR), F.col("word").substr(F.lit(1), F.col("i")))
    )
    letter = F.col("word").substr(F.col("i"), F.lit(1))
    before = F.when(F.col("i") > 1, F.col("word").substr(F.col("i") - 1, F.lit(1))).otherwise(F.lit(""))
    whole = F.struct(F.col("rotation").alias("key"), F.lit(1).alias("kind"), F.lit(False).alias("first"))
    rest = F.struct(F.col("rotation").substr(F.lit(1), size).alias("key"), F.lit(0).alias("kind"), (letter != before).alias("first"))
    rows = turned.select("id", "n", F.explode(F.when(F.col("i") > 0, F.array(whole, rest)).otherwise(F.array(whole))).alias("r"))
    key = F.when(F.length("r.key") > LONGEST_KEY, F.sha2(F.col("r.key").cast("binary"), 256)).otherwise(F.col("r.key"))
    return rows.select(key.alias("key"), F.col("r.kind").alias("kind"), F.col("r.first").alias("first"), "id", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, word, n) with ids in the words' order -> (id, n_near, best_n, best_id) of the words that have any near word.

    Near words differ by exactly one inserted, deleted or replaced code point; the best is the most frequent one, of equally
    frequent ones that with the smallest id.
    """
    ordered = _rotations(words).repartitionByRange("key")
    by_key = Window.partitionBy("key").orderBy("kind", F.col("n").desc(), "id")
    group = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row, part = F.struct("n", (-F.col("id")).alias("back")), F.col("kind") == 0
    scanned = ordered.select(
        "id",
        "kind",
        "first",
        F.row_number().over(by_key).alias("place"),
        F.sum(part.cast("long")).over(group).alias("parts"),
        F.sum((part & F.col("first")).cast("long")).over(group).alias("firsts"),
        F.max(F.when(~part, row)).over(group).alias("whole"),
        F.max(F.when(part & F.col("first"), row)).over(group).alias("best_first"),
        F.first(row).over(group).alias("top"),
        F.nth_value(row, 2).over(group).alias("second"),
    )
    shorter = F.col("first") & F.col("whole").isNotNull()
    other = F.when(F.col("parts") > 1, F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top")))
    near = scanned.select(
        "id",
        F.when(F.col("kind") == 1, F.col("firsts")).otherwise(F.col("parts") - 1 + shorter.cast("long")).alias("near"),
        F.when(F.col("kind") == 1, F.col("best_first")).otherwise(F.greatest(other, F.when(shorter, F.col("whole")))).alias("best"),
    )
    # an edit that joins two words has one place in them (the first of a double letter), so counts add up
    best = near.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return best.select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.back")).alias("best_id"))


def follow(forms: DataFrame) -> DataFrame:
    """(id, form_id) -> (id, root_id), the last id along the forms; each round doubles the steps already taken.

    Forms must lead to an end (here each is more frequent than the word before it).
    """
    steps = stored(forms.select("id", F.col("form_id").alias("root_id")), "spelling-roots")
    while True:
        further = steps.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        moved = stored(steps.join(further, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if moved.filter("moved").isEmpty():
            return moved.select("id", "root_id")
        steps = moved.drop("moved")


def spelling_variants(counts: DataFrame, factor: int = 10) -> DataFrame:
    """(word, n), each word once and without ``$`` -> word, form, root, n, n_near, form_n.

    ``form`` is the most frequent near word (ties: the smallest in code-point order) if it is at least ``factor`` (over 1)
    times as frequent as the word, else null; ``root`` is the last word along the forms, the word itself without any.
    ``n_near`` counts near words. Null and empty words have no near ones. An empty table gives an empty result.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1")
    # a counted table is small beside the text it comes from: it is ordered once, and ids stand for words from then on
    ranged = stored(counts.select("word", "n"), "spelling-counts").repartitionByRange("word").sortWithinPartitions("word")
    words = stored(ranged.select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n")), "spelling-words")
    near = stored(neighbours(words.filter(F.length("word") > 0)), "spelling-neighbours")
    formed = words.join(near, "id").filter(F.col("best_n") >= factor * F.col("n"))
    forms = stored(formed.select("id", F.col("best_id").alias("form_id"), F.col("best_n").alias("form_n")), "spelling-forms")
    named = words.select(F.col("id").alias("other"), F.col("word").alias("name"))
    linked = (
        forms.join(follow(forms), "id")
        .join(named.withColumnRenamed("name", "form"), F.col("form_id") == F.col("other"))
        .drop("other")
        .join(named.withColumnRenamed("name", "root"), F.col("root_id") == F.col("other"))
        .select("id", "form", "root", "form_n")
    )
    whole = words.join(near.select("id", "n_near"), "id", "left").join(linked, "id", "left")
    return whole.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
