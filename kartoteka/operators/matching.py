"""Which texts contain which terms, for many texts and many terms at once.

Texts are cut into grams, runs of `GRAM` characters. A term is looked for only in texts that have the
rarest of its grams: an equi-join on grams gives candidates, and `contains` decides. Rows are read
twice however many terms there are, once to count the grams that terms have and once to join. A
term with a gram that no text has is dropped at once. Terms shorter than a gram are grams
themselves, of their own length; the empty term is in every text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.operators.joins import join_spread, measured
from kartoteka.operators.tables import staged_table
from kartoteka.operators.topk import merge_top

GRAM = 3
MAX_LISTED = 64  # terms that are looked for one after another in one expression


def grams(text: str | Column, size: int = GRAM) -> Column:
    """The distinct runs of `size` characters of a text; none of a text that is shorter."""
    if size == 0:
        return F.array(F.lit(""))
    # one compiled expression: lambdas over arrays are interpreted for each character, and keep explode and join from being compiled together
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def _grams_of_sizes(text: str | Column, sizes: Sequence[int]) -> Column:
    return grams(text, sizes[0]) if len(sizes) == 1 else F.flatten(F.array(*[grams(text, n) for n in sizes]))


def gram_counts(data: DataFrame, text: str, among: DataFrame | None = None, sizes: Sequence[int] = (GRAM,)) -> DataFrame:
    """(gram, n): how many texts have each gram, in lower case. Store it with a table that is searched often."""
    found = data.where(F.col(text).isNotNull()).select(F.explode(_grams_of_sizes(F.lower(text), sizes)).alias("gram"))
    if among is not None:
        found = found.join(measured(among.select("gram").distinct()), "gram", "left_semi")
    return found.groupBy("gram").agg(F.count("*").alias("n"))


def _sizes(terms: DataFrame, term: str) -> list[int]:
    """Lengths of grams that the terms need: at most `GRAM` and those below."""
    return sorted(r[0] for r in terms.select(F.least(F.length(term), F.lit(GRAM))).distinct().collect())


def rarest_grams(terms: DataFrame, term: str, counts: DataFrame) -> DataFrame:
    """(term, gram): the gram of each term that the fewest texts have. Terms with a gram that no text has are left out."""
    whole = F.when(F.length(term) < GRAM, F.array(F.col(term))).otherwise(grams(term))
    listed = terms.select(term, F.explode(whole).alias("gram"))
    counted = join_spread(listed, counts.select(F.col("gram").alias("__gram"), "n"), {"gram": "__gram"})
    return (counted.groupBy(term).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("missing"))
            .where("missing = 0").select(term, "gram"))


def containing(data: DataFrame, text: str, terms: DataFrame, term: str, counts: DataFrame | None = None) -> DataFrame:
    """The rows of `data` with every term (in lower case, in the column `term`) that their text contains, in any case.

    `counts` are stored `gram_counts` of the texts; without them they are counted here.
    """
    sought = staged_table(terms.select(F.lower(term).alias(term)).where(F.col(term).isNotNull()).distinct(), "terms")
    sizes = _sizes(sought, term)
    if not sizes:
        return data.withColumn(term, F.lit(None).cast("string")).limit(0)
    if counts is None:
        asked = sought.select(F.explode(F.when(F.length(term) < GRAM, F.array(F.col(term))).otherwise(grams(term))).alias("gram"))
        counts = gram_counts(data, text, asked, sizes)
    elif min(sizes) < GRAM:
        short = sought.where(F.length(term) < GRAM).select(F.col(term).alias("gram"))
        counts = counts.unionByName(gram_counts(data, text, short, [n for n in sizes if n < GRAM]))
    chosen = staged_table(rarest_grams(sought, term, counts), "rarest_grams")
    # lower case once for each text, not for each of its grams
    rows = data.where(F.col(text).isNotNull()).withColumn("__lower", F.lower(text)).withColumn("__gram", F.explode(_grams_of_sizes("__lower", sizes)))
    met = rows.join(measured(chosen.withColumnRenamed("gram", "__chosen")), F.col("__gram") == F.col("__chosen"))
    return met.where(F.contains("__lower", F.col(term))).select(*data.columns, term)


def first_containing(
    data: DataFrame, text: str, terms: DataFrame, term: str, k: int, *, order: Sequence[str],
    carry: Sequence[str] = (), counts: DataFrame | None = None,
) -> DataFrame:
    """(term, rank, order..., carry...) of the first k rows whose text contains the term, in any case.

    `order` must identify the row. Each term is looked for once, however many questions ask for it,
    and every task sends the first k rows of a term only.
    """
    carried = [c for c in carry if c not in order]
    rows = data.select(F.col(text).alias("__text"), *order, *carried)
    found = containing(rows, "__text", terms, term, counts).drop("__text")
    ranked = merge_top(found, [term], list(order), k, salt_on=list(order), rank_as="rank")
    return ranked.select(term, "rank", *order, *carried)


def first_contained(
    df: DataFrame, key: str, text: str, terms: DataFrame, term: str, rank: str, take: str, out: str, max_listed: int = MAX_LISTED,
) -> DataFrame:
    """Add `take` of the lowest-ranked term that the text contains, NULL when there is none.

    A few terms go into one expression over the texts; more are joined by their rarest grams.
    """
    listed = terms.select(F.lower(term).alias("__term"), F.col(rank).alias("__rank"), F.col(take).cast("string").alias("__take")).where(F.col("__term") != "")
    few = listed.orderBy("__rank", "__term", "__take").limit(max_listed + 1).collect()
    if len(few) <= max_listed:
        pairs = [F.struct(F.lit(r["__term"]).alias("term"), F.lit(r["__take"]).alias("take")) for r in few]
        first = F.get(F.filter(F.array(*pairs), lambda p: F.contains(F.lower(text), p["term"])), F.lit(0))["take"] if pairs else F.lit(None).cast("string")
        return df.withColumn(out, first)
    found = containing(df.select(key, F.col(text).alias("__text")), "__text", listed.select("__term"), "__term").drop("__text")
    named = join_spread(found, measured(listed.withColumnRenamed("__term", "__listed")), {"__term": "__listed"})
    best = named.groupBy(F.col(key).alias("__key")).agg(F.min_by("__take", F.struct("__rank", "__term", "__take")).alias(out))
    return join_spread(df, best, {key: "__key"}).drop("__key")
