"""Mixing sources to target weights by weighted sampling with exponential keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalograft.llm.common import WORD, set_aside
from catalograft.session import settle

#: Weights of the sources in code point order, repeated as often as needed.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix holds this share of all words.
SHARE = 1.5
#: No source is repeated more often than this.
MOST_EPOCHS = 2.0
#: About so many documents share one piece of a source's order.
PIECE_ROWS = 10_000


def quality_weight(text: Column, size: Column) -> Column:
    """A weight in [0.5, 1]: low for texts of few words or of odd mean word length."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    usual = F.greatest(F.lit(0.0), 1 - F.abs(mean - 6.5) / 10)
    return F.coalesce(0.5 + 0.5 * usual * size / (size + 20), F.lit(0.5))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, target) of a table (source, source_size, n_docs).

    Water filling: sources whose limit binds first (smallest limit per weight) take
    their limit, the others share the rest by weight. One row per source, so the
    ordering windows see the list of sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    ranked = sizes.select("*", weight.alias("w"), (F.col("source_size") * MOST_EPOCHS).alias("limit"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * SHARE
    # what a unit of weight gets if the sources before take their limits
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    # it rises while the next source takes less than its share, then falls
    final = F.max("level").over(everything)
    return ranked.select("*", level.alias("level")).select(
        "source",
        "source_size",
        "n_docs",
        F.least(F.col("limit"), final * F.col("w")).alias("target"),
    )


def mix_sources(docs: DataFrame, seed: int = 17) -> DataFrame:
    """How many words of each document the mix takes.

    In: doc_id, text, source (other columns are ignored). Out, one row per row:
    doc_id, size, source_size, target, taken, text_key. Every source first gives
    floor(target / size) complete epochs. The rest of its target is sampled without
    replacement: documents come in the order of -ln(u) / quality, u drawn from a hash of
    doc_id and seed, and the one that crosses the budget gives only the words still
    missing. So no document gives more than twice its size, and reruns agree.

    A source's order is cut into pieces by key: only a piece is sorted by one task, and
    the sums of the pieces carry the budget across them, so one source may hold most rows.

    Null source: a source of its own, last in order. Null or empty text: size and
    taken 0. Repeated rows: each counts by itself, in an order fixed by the text. No rows:
    no rows.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select("doc_id", "text", "source", size.alias("size"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    # 48 random bits, never 0
    uniform = (F.conv(F.substring(draw, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = settle(
        sized.select(
            "doc_id",
            "source",
            "size",
            (-F.log(uniform) / quality_weight(F.col("text"), F.col("size"))).alias("key"),
            text_key(F.col("text")).alias("tie"),
        )
    )
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    )
    same = F.col("r.source").eqNullSafe(F.col("t.source"))
    # 1 - exp(-key) rises with the key and is nearly uniform
    piece = F.floor((1 - F.exp(-F.col("key"))) * F.ceil(F.col("n_docs") / PIECE_ROWS))
    placed = rows.alias("r").join(targets.alias("t"), same).select(
        "r.doc_id", "r.source", "size", "key", "tie", "source_size", "target", piece.alias("piece")
    )
    sums = placed.groupBy("source", "piece").agg(F.sum("size").alias("piece_size"))
    earlier = (
        Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sums.select(
        F.col("source").alias("s"),
        F.col("piece").alias("p"),
        F.coalesce(F.sum("piece_size").over(earlier), F.lit(0)).alias("start"),
    )
    ordered = (
        Window.partitionBy("source", "piece")
        .orderBy("key", F.col("doc_id").asc_nulls_last(), "tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = placed.select("*", F.coalesce(F.sum("size").over(ordered), F.lit(0)).alias("inside"))
    joined = inside.join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p"))
    )
    goal = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - epochs * F.col("source_size") - F.col("start") - F.col("inside")
    fraction = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select(
        "doc_id",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (epochs * F.col("size") + fraction).cast("long").alias("taken"),
        F.col("tie").alias("text_key"),
    )


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart and orders them."""
    return F.md5(F.coalesce(text, F.lit("")))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as taken, then its first words still wanted.

    Columns but doc_id and text may have any name and type."""
    docs, named = set_aside(docs, "doc_id", "text")
    taken = mixed.groupBy("doc_id", "text_key").agg(F.sum("taken").alias("__taken"), F.first("size").alias("__size"))
    taken = taken.where("__taken > 0").withColumnsRenamed({"doc_id": "__i", "text_key": "__t"})
    keyed = docs.withColumn("__k", text_key(docs["text"]))
    copy = Window.partitionBy("doc_id", "__k").orderBy(F.lit(0))
    single = keyed.withColumn("__c", F.row_number().over(copy)).where("__c = 1")
    met = single.join(taken, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__k") == F.col("__t")))
    words = F.expr("transform(sequence(0, cast((__taken - 1) div __size as int)), i -> least(__size, __taken - i * __size))")
    each = met.withColumn("__w", F.explode(words))
    text = F.when(F.col("__w") == F.col("__size"), F.col("text")).otherwise(take_words(F.col("text"), F.col("__w")))
    return named(each.withColumn("text", text).select(docs.columns))


def take_words(text: Column, n: Column) -> Column:
    """The first n words of a text with the space between them, for a document cut by a budget."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")
