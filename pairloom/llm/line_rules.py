"""Quality rules: counts within a text, and lines that too many documents of a host share.

Only DataFrame functions; every step works on rows of hashes and counts, the text itself
is read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import WHITE, words_of
from pairloom.llm.minhash import near_copies
from pairloom.session import materialize, scratch

#: A line is boilerplate if more than LINE_FLOOR distinct texts of its host hold it, however many texts the host has.
LINE_FLOOR = 20
#: A caller may raise the limit to a share of the host's distinct texts; no query does.
LINE_SHARE = 0.0
#: A document is depleted if less than this share of its words is left.
KEPT_SHARE = 0.5
#: Salt of the join with boilerplate lines: a line that a third of all documents hold is split so often.
SALT = 16
#: Bands of the near copies that count a line once; if registers are independent, two texts that are just similar are missed once in 4,600 times.
GROUP_BANDS = 16


def normalised_lines(text: Column) -> Column:
    """Lines in lower case, white space squeezed and trimmed; empty ones left out."""
    odd = text.rlike("[\\t\\x0B-\\r]|  ")
    squeezed = F.when(odd, F.regexp_replace(text, "[ \\t\\x0B-\\r]+", " ")).otherwise(text)
    return F.filter(F.transform(F.split(F.lower(squeezed), "\\n"), F.trim), lambda line: line != "")


def host_key(host: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("")))


def text_counts(rows: DataFrame) -> DataFrame:
    """Adds the counts of the base rules for the column ``body`` (never null), and drops nothing."""
    h = F.col("hashes")
    pairs = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice(h, 3, F.size(h)), lambda a, b: F.xxhash64(a, b))
    lines = F.filter(F.split("body", "\\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    rows = rows.withColumn("words", words_of(F.col("body"))).withColumn("lines", lines)
    rows = rows.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.withColumn("hashes", F.transform("words", lambda word: F.xxhash64(word)))
    # The last two pairs have no third word; a text of under three words has no window.
    whole = F.slice(triples, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    rows = rows.withColumn("triples", whole)
    # Equal windows become neighbours when sorted; a text without any skips the sort.
    placed = F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    unique = F.size(F.array_distinct("triples")) == F.size("triples")
    rows = rows.withColumn("placed", F.when(unique, F.lit(None)).otherwise(placed))
    p = F.col("placed")
    twins = F.filter(
        p,
        lambda s, j: F.coalesce(F.get(p, j - 1)["h"] == s["h"], F.lit(False))
        | F.coalesce(F.get(p, j + 1)["h"] == s["h"], F.lit(False)),
    )
    rows = rows.withColumn("at", F.sort_array(F.transform(twins, lambda s: s["i"])))
    at = F.col("at")
    covered = F.aggregate(
        F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return rows.drop("words", "lines", "hashes", "triples", "placed", "at")


def score_rules(
    docs: DataFrame,
    host: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    floor: int = LINE_FLOOR,
    share: float = LINE_SHARE,
    kept_share: float = KEPT_SHARE,
    near: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts, and the lines to remove from each text.

    Verdicts hold one row per input row: doc_id, host_key, text_key, the counts, base_failed,
    n_removed_words and kept. A text fails the base rules with under 50 words or if over half
    of its words lie in repeated three-word windows. A line is removed if the number of
    distinct texts of its host that hold it is over ``floor`` (and over ``share`` of the host's
    texts, if given): copies of one text count once, and small and large hosts have one limit.
    With ``near`` a group of near copies counts once too, else its own lines would pass the
    limit and no text of the group would be left.
    A document is depleted, and rejected, if less than ``kept_share`` of its words remain.
    The second table has (host_key, text_key, n_removed_words, removed) for the texts with
    boilerplate lines, which it names by the hash of the normalised line.

    Null texts are empty and fail the base rules; null hosts form one host with the empty
    name; repeated rows get equal verdicts; an empty table gives empty tables; columns
    other than the three named are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        host_key(host).alias("host_key"),
        F.xxhash64(body).alias("text_key"),
        body.alias("body"),
        F.transform(
            normalised_lines(body),
            lambda line: F.struct(
                F.xxhash64(line).alias("line"),
                (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"),
            ),
        ).alias("own"),
    )
    rows = materialize(text_counts(rows).drop("body"), "line_rules")

    texts = rows.groupBy("host_key", "text_key").agg(F.first("own").alias("own"))
    texts = materialize(texts, "line_texts")
    lines = texts.select("host_key", F.explode(F.array_distinct("own.line")).alias("line"))
    frequent = lines.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") > floor)
    if share:
        limits = texts.groupBy("host_key").agg(F.greatest(F.lit(floor), F.count(F.lit(1)) * share).alias("limit"))
        frequent = frequent.join(limits, "host_key").where(F.col("n_texts") > F.col("limit"))
    else:
        frequent = frequent.withColumn("limit", F.lit(floor))
    frequent = materialize(frequent, "frequent_lines")
    removed = _removed(texts, frequent)
    if near and not frequent.isEmpty():
        with scratch(docs.sparkSession) as keep:
            frequent = keep(_by_group(docs.select(body.alias("body")), removed, frequent))
        removed = _removed(texts, frequent)
    rows = rows.drop("own").join(removed.drop("removed"), ["host_key", "text_key"], "left")
    gone = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdicts = rows.select(
        "doc_id", "host_key", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        gone.alias("n_removed_words"),
        (~failed & (F.col("n_words") - gone >= kept_share * F.col("n_words"))).alias("kept"),
    )
    return verdicts, removed


def _by_group(bodies: DataFrame, removed: DataFrame, frequent: DataFrame) -> DataFrame:
    """Those frequent lines that are over the limit with every group of near copies counted once.

    Counting by group only lowers a count, so only the texts with a frequent line are grouped.
    """
    wanted = materialize(removed.select("text_key").distinct(), "line_holders").withColumnRenamed("text_key", "__text")
    holders = bodies.join(wanted.hint("shuffle_hash"), F.xxhash64("body") == F.col("__text"))
    classes = near_copies(holders, "__text", "body", bands=GROUP_BANDS, native=True)
    classes = materialize(classes.select(F.col("k1").alias("text_key"), "class_id").distinct(), "line_groups")
    held = removed.join(classes, "text_key").select("host_key", F.explode("removed").alias("line"), "class_id").distinct()
    counts = held.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("n_groups"))
    over = frequent.join(materialize(counts, "line_counts"), ["host_key", "line"]).where(F.col("n_groups") > F.col("limit"))
    return materialize(over.drop("n_groups"), "frequent_lines")


def _removed(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """Stored (host_key, text_key, n_removed_words, removed: line hashes) for the texts that hold a boilerplate line.

    Every occurrence of a line counts.
    """
    occurring = texts.select(
        "host_key", "text_key", F.pmod("text_key", F.lit(SALT)).alias("salt"), F.explode("own").alias("one")
    ).select("host_key", "text_key", "salt", F.col("one.line").alias("line"), F.col("one.words").alias("words"))
    salted = frequent.select("host_key", "line", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    found = occurring.join(salted.withColumn("salt", F.col("salt").cast("bigint")), ["host_key", "line", "salt"])
    return materialize(
        found.groupBy("host_key", "text_key").agg(
            F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed")
        ),
        "removed_lines",
    )


def apply_rules(docs: DataFrame, host: str = "source", text: str = "text", **limits: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns, without their boilerplate lines.

    A line counts once per group of near copies, so that such a group is left for the next stage.

    ``n_chars`` (if there) is set to the new length where lines went. The verdict and the
    lines follow from host and text alone, so they are joined on both; only texts with
    something to do are on the small side, which is hashed, so that texts are not sorted.
    """
    own = docs.withColumn("doc_id", F.lit(None).cast("long")) if "doc_id" not in docs.columns else docs
    verdicts, removed = score_rules(own, host=host, text=text, near=True, **limits)
    keys = ["host_key", "text_key"]
    rejected = verdicts.where(~F.col("kept")).select(*keys).distinct().withColumn("rejected", F.lit(True))
    actions = materialize(rejected.join(removed.select(*keys, "removed"), keys, "full"), "actions").select(
        F.col("host_key").alias("__host"), F.col("text_key").alias("__text"), "rejected", F.col("removed").alias("__removed")
    )
    actions = actions.withColumnRenamed("rejected", "__rejected").hint("shuffle_hash")
    same = (host_key(host) == F.col("__host")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__text"))
    joined = docs.join(actions, same, "left").where(F.col("__rejected").isNull())
    normal = lambda line: F.xxhash64(F.trim(F.lower(F.regexp_replace(line, "[ \\t\\x0B-\\r]+", " "))))
    left = F.filter(F.split(text, "\\n"), lambda line: ~F.array_contains("__removed", normal(line)))
    changed = F.col("__removed").isNotNull()
    joined = joined.withColumn(text, F.when(changed, F.array_join(left, "\n")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        size = F.length(text).cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)
