"""License scans by diagonal voting, in DataFrame functions only.

Every rolling pair of words of a text is hashed and joined to the positions of the same pair in license templates. Matches of one
template at one offset (text position less template position: a diagonal) vote together; neighbouring diagonals merge, which bridges
inserted or lost words, and the span is verified by the share of the template's pairs it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .license_texts import PARAGRAPHS

#: Phrases of consecutive words and their labels. These count as base matches.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further names of licenses, whole phrases that prose does not use by chance; paragraphs of license texts come beside them.
NAMES = (
    ("cc by 4 0", "cc-by"), ("cc by sa 4 0", "cc-by-sa"), ("cc by nc 4 0", "cc-by-nc"), ("creative commons attribution", "cc-by"),
    ("bsd 2 clause license", "bsd"), ("bsd 3 clause license", "bsd"), ("mozilla public license", "mpl"), ("eclipse public license", "epl"), ("boost software license", "boost"),
)
#: Word pairs of a passage that ordinary prose is full of; they don't vote.
WEAK = {"of", "the", "to", "and", "in", "is", "a", "or", "it", "this", "by", "be", "on", "an", "as", "are", "that"}


@dataclass(frozen=True)
class Template:
    number: int
    words: tuple[str, ...]
    label: str
    base: bool
    phrase: bool  # counts in full only, a paragraph by its share

    def pairs(self) -> list[tuple[int, str, str]]:
        both = list(enumerate(zip(self.words, self.words[1:], strict=False)))
        return [(k, a, b) for k, (a, b) in both if self.phrase or not {a, b} <= WEAK]


_RANKED = [*((t, x, True, True) for t, x in BASE.items()), *((t, x, False, True) for t, x in NAMES), *((t, x, False, False) for t, x in PARAGRAPHS)]
TEMPLATES = tuple(Template(i, tuple(t.split()), label, base, phrase) for i, (t, label, base, phrase) in enumerate(_RANKED))


def words_of(text: Column) -> Column:
    """Words of ASCII letters and digits and of all characters beyond, A-Z in lower case; none for null."""
    # lower() also maps the Kelvin sign to an ASCII letter, which the word class would not
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.7, gap: int = 3) -> DataFrame:
    """One row for each row of `docs`: base phrases, labels and a score.

    n_words: words of the text. n_base: places where a base phrase stands; first_word and last_word: the least and the largest of
    them (words from 0; null without one). base_labels, labels: distinct, sorted, comma-joined ('' without one). score: the largest
    share of a template's voting pairs in one span, 0 to 1; paragraphs count as found from `min_share` on, names in full. `gap`: how far apart diagonals may lie to merge. Null or empty texts: no words, no labels, score 0. Repeated rows and
    null ids stay; other columns of `docs` aren't read.
    """
    spark = docs.sparkSession
    pairs = [(t.number, k, a, b) for t in TEMPLATES for k, a, b in t.pairs()]
    table = spark.createDataFrame(pairs, "template int, place int, left string, right string").withColumn("pair", F.xxhash64("left", "right"))
    hashes = [r["pair"] for r in table.select("pair").distinct().collect()]  # as many as the constant templates have
    about = spark.createDataFrame([(t.number, t.label, t.base, t.phrase, len(t.pairs()), len(t.words)) for t in TEMPLATES], "template int, label string, base boolean, phrase boolean, n_pairs int, length int")

    words = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("w"))
    n = F.size("w")
    rolled = F.zip_with(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), F.slice("w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(F.xxhash64(a, b).alias("pair"), a.alias("a"), b.alias("b")))
    numbered = F.transform(rolled, lambda x, i: F.struct(i.alias("pos"), x["pair"].alias("pair"), x["a"].alias("a"), x["b"].alias("b")))
    kept = F.filter(numbered, lambda x: x["pair"].isin(hashes))
    rows = durable(words.select("doc_id", n.cast("long").alias("n_words"), kept.alias("hits")).withColumn("row", F.monotonically_increasing_id()))

    hits = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    matched = hits.join(F.broadcast(table), (hits["pair"] == table["pair"]) & (hits["a"] == table["left"]) & (hits["b"] == table["right"]))
    votes = matched.groupBy("row", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("place").alias("places"))
    votes = votes.join(F.broadcast(about), "template")

    short = votes.where(F.col("phrase") & (F.col("votes") == F.col("n_pairs"))).select("row", "label", "base", F.col("first").cast("long").alias("at"), F.lit(1.0).alias("share"))
    order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    step = (F.col("diagonal") - F.lag("diagonal").over(order) > gap) | (F.lag("diagonal").over(order) - F.col("diagonal") > gap) | (F.col("first") - F.lag("first").over(order) > F.col("length") + gap)
    spans = votes.where(~F.col("phrase")).withColumn("new", F.coalesce(step, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "template", "span", "label", "n_pairs").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("first").alias("at"))
    long = spans.select("row", F.when(F.col("votes") >= min_share * F.col("n_pairs"), F.col("label")).alias("label"), F.lit(False).alias("base"), F.col("at").cast("long").alias("at"), (F.col("votes") / F.col("n_pairs")).alias("share"))

    base = F.col("base") & F.col("label").isNotNull()
    join = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    found = short.union(long).groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("at"))).alias("first_word"), F.max(F.when(base, F.col("at"))).alias("last_word"),
        join(F.when(base, F.col("label"))).alias("base_labels"), join("label").alias("labels"), F.max("share").alias("score"),
    )
    return rows.drop("hits").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
