"""Spelling variants: words one letter apart, found by partition-and-enumerate signatures of their letters.

A word's letters are a multiset, that is a binary vector with a dimension per (letter, occurrence).  A replaced letter
changes two dimensions, an inserted or deleted one changes one.  The dimensions are partitioned by letter into a few
classes; leaving out each choice of as many classes as dimensions may differ, and hashing the letters of the others,
gives signatures of which two words within that distance share at least one.  So words of one length meet on
signatures that leave out two of ``CLASSES``, words whose lengths differ by one on signatures that leave out one of
``CLASSES_NEXT``.  One edit also leaves one half of a word as it was, at its place; every signature therefore comes
twice, with the first half and with the second, which keeps anagrams apart and groups small whatever the vocabulary.
The equi-join's candidates are then verified by their edit distance; pairs found by several signatures count once.

Texts are split whole; counts are made per distinct word before anything is shuffled, so a word that fills a third of
all texts is one row per task.  Null and empty texts have no words; repeated rows count each time; a null id counts as
an empty string in the hash that spoils a word.  Equally frequent near words are told apart by code-point order.  No
documents give no rows.  Other columns are not read.  A very long text is one array of its words in one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import ascii_lower, whole, written

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form is at least so many times as frequent as its variant.
RATIO = 2
SPOIL = 97
CLASSES = 4
CLASSES_NEXT = 3
#: A run of word letters of at least LEAST_LENGTH; shorter ones cannot become words.
RUN = r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH

_BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
_BEYOND = "".join(map(chr, range(0xC0, 0x100)))


def occurrences(docs: DataFrame) -> DataFrame:
    """A row per run of letters, A-Z lower-cased; where SPOIL divides the hash, without the letter the hash names."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(whole()), F.lit(RUN), F.lit(0))).alias("_run"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_run")
    at = (F.col("_hash") % F.length("_run")).cast("int")
    spoilt = F.concat(F.substring("_run", F.lit(1), at), F.expr("substring(_run, cast(_hash % length(_run) as int) + 2)"))
    hashed = runs.select("_run", F.crc32(key.cast("binary")).alias("_hash"))
    return hashed.select(F.when(F.col("_hash") % SPOIL == 0, spoilt).otherwise(F.col("_run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: distinct words that are long and frequent enough."""
    long_enough = occurrences(docs).filter(F.length("word") >= LEAST_LENGTH)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _class_letters(classes: int) -> list[Column]:
    """The sorted letters of the word that belong to each class."""
    of = [_BY_FREQUENCY[c::classes] + _BEYOND[c::classes] for c in range(classes)]
    return [F.translate("_letters", "".join(of[:c] + of[c + 1 :]), "") for c in range(classes)]


def _signatures(length: Column, first: Column, second: Column, classes: int, apart: int) -> Column:
    """An array of 64-bit signatures: which classes are left out, the letters of the others, and either half."""
    found = []
    for left_out in combinations(range(classes), apart):
        kept = [F.col(f"_class{c}") for c in range(classes) if c not in left_out]
        for side, half in enumerate((first, second)):
            found.append(F.xxhash64(F.lit(f"{left_out}{side}"), length, half, *kept))
    return F.array(*found)


def _parted(words: DataFrame, classes: int) -> DataFrame:
    letters = words.withColumn("_letters", F.array_join(F.array_sort(F.split("word", "")), ""))
    columns = {f"_class{c}": letters_ for c, letters_ in enumerate(_class_letters(classes))}
    return letters.withColumns(columns).withColumn("_length", F.length("word"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every two words (columns word, n) that one edit turns into each other, once."""
    same, next_ = _parted(words, CLASSES), _parted(words, CLASSES_NEXT)

    def keyed(df: DataFrame, length: str, second_from: str, classes: int, apart: int, names: tuple[str, str]) -> DataFrame:
        half = f"cast({length} / 2 as int)"
        signatures = _signatures(
            F.expr(length), F.expr(f"substring(word, 1, {half})"), F.expr(f"substring(word, {half} + {second_from})"), classes, apart
        )
        return df.select(F.explode(signatures).alias("_key"), F.col("word").alias(names[0]), F.col("n").alias(names[1]))

    one, other = ("word", "n"), ("other", "other_n")
    distance = F.levenshtein(F.col("word"), F.col("other"), 1) == 1
    equal_long = keyed(same, "_length", "1", CLASSES, 2, one).join(keyed(same, "_length", "1", CLASSES, 2, other), "_key")
    equal_long = equal_long.filter((F.col("word") < F.col("other")) & distance)
    # the longer word, without one letter, is the shorter: its second half begins one letter later
    longer = keyed(next_, "(_length - 1)", "2", CLASSES_NEXT, 1, other)
    one_more = keyed(next_, "_length", "1", CLASSES_NEXT, 1, one).join(longer, "_key").filter(distance)
    return equal_long.unionByName(one_more).drop("_key").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form (columns word, form): where following forms ends.

    Pointers double each round.  A form is at least twice as frequent as its word, so there are no circles, chains are
    no longer than the logarithm of the greatest count, and rounds no more than the logarithm of that.
    """
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = ends.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
        )
        stepped = written(stepped, "spelling-roots")
        ends = stepped.select("word", "root")
        if stepped.filter("_moved").isEmpty():
            return ends


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``docs`` (doc_id, text)."""
    words = written(vocabulary(docs), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    turned = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    around = pairs.unionByName(turned).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("form"))).alias("_best")
    )
    enough = -F.col("_best.rank") >= RATIO * F.col("n")
    best = around.select(
        "word",
        "n_near",
        F.when(enough, F.col("_best.form")).alias("form"),
        F.when(enough, -F.col("_best.rank")).alias("form_n"),
    )
    best = written(best, "spelling-forms")
    ends = roots(best.filter("form is not null"))
    joined = reduce(lambda left, right: left.join(right, "word", "left"), (best, ends), words)
    return joined.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
