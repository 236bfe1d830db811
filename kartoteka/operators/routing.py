"""Rules that decide how a question is answered, and the answers, for a table of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.text import drop_words, has_word, is_blank, strip
from kartoteka.operators.joins import join_spread, measured
from kartoteka.operators.matching import first_contained, first_containing
from kartoteka.operators.tables import staged_table
from kartoteka.operators.topk import merge_top
from kartoteka.sources.landing import SUBMISSION_FIELDS

# Phrases that ask about a component, in order of precedence.
INFO_PHRASES = ("what is", "tell me about", "describe", "definition of", "info about")

# Words left out of the name asked for.
FILLER_WORDS = ("the", "ingredient")

# Words that ask to add an item.
ADD_WORDS = ("inserir", "insert", "adicionar", "add", "criar", "create", "nova receita", "new recipe")

# Words that name a place, in order of precedence, with the place's stored name.
PLACE_ALIASES = (
    ("brazilian", "Brazil"), ("brazil", "Brazil"),
    ("italian", "Italy"), ("italy", "Italy"),
    ("mexican", "Mexico"), ("mexico", "Mexico"),
    ("indian", "India"), ("india", "India"),
    ("french", "France"), ("france", "France"),
    ("chinese", "China"), ("china", "China"),
    ("japanese", "Japan"), ("japan", "Japan"),
    ("thai", "Thailand"), ("thailand", "Thailand"),
    ("american", "United States"), ("usa", "United States"),
    ("greek", "Greece"), ("greece", "Greece"),
    ("spanish", "Spain"), ("spain", "Spain"),
)

# Rows shown for a place or a name.
SHOWN = 20


def normalised(text: str) -> Column:
    return F.lower(strip(text))


def _info_phrase(query: Column) -> Column:
    """The first listed phrase the question has, or NULL."""
    phrases = F.array(*[F.lit(p) for p in INFO_PHRASES])
    return F.get(F.filter(phrases, lambda p: F.contains(query, p)), F.lit(0))


def asks_info(query: Column) -> Column:
    return _info_phrase(query).isNotNull()


def extract_term(query: Column) -> Column:
    """What the question asks about: the text after the first listed phrase it has, without fillers."""
    rest = F.coalesce(F.call_function("substring_index", query, _info_phrase(query), F.lit(-1)), query)
    return drop_words(rest, FILLER_WORDS)


def place_of(query: Column, aliases: Sequence[tuple[str, str]] = PLACE_ALIASES) -> Column:
    """The place of the first listed alias in the text; for short, fixed lists."""
    listed = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(p).alias("place")) for a, p in aliases])
    return F.get(F.filter(listed, lambda a: F.contains(query, a["alias"])), F.lit(0))["place"]


def detect_place(questions: DataFrame, key: str, text: str, aliases: DataFrame | Sequence[tuple[str, str]],
                 out: str = "place", **limits: int) -> DataFrame:
    """Add the place a text names. An alias table has (rank, alias, place); the lowest rank wins."""
    if isinstance(aliases, DataFrame):
        return first_contained(questions, key, text, aliases, "alias", "rank", "place", out, **limits)
    return questions.withColumn(out, place_of(F.lower(text), aliases))


def classify_chat(text: str) -> Column:
    """Chat rule: a wish to add an item gets the form, anything else a similarity search."""
    return (
        F.when(is_blank(text), "empty_query")
        .when(has_word(text, ADD_WORDS), "template")
        .otherwise("item_search")
    )


def classify_questions(questions: DataFrame, key: str, text: str,
                       aliases: DataFrame | Sequence[tuple[str, str]] = PLACE_ALIASES, **limits: int) -> DataFrame:
    """(key, query, route, subject). Component questions come first, then places, then item names."""
    asked = questions.select(key, normalised(text).alias("query"))
    asked = detect_place(asked, key, "query", aliases, "__place", **limits)
    query = F.col("query")
    route = (
        F.when(F.coalesce(query == "", F.lit(True)), "empty_query")
        .when(asks_info(query), "component_info")
        .when(F.col("__place").isNotNull(), "place")
        .otherwise("name")
    )
    routed = asked.withColumn("route", route)
    subject = (
        F.when(F.col("route") == "component_info", extract_term(query))
        .when(F.col("route") == "place", F.col("__place"))
        .when(F.col("route") == "name", query)
    )
    return routed.select(key, "query", "route", subject.alias("subject"))


def component_info(terms: DataFrame, term: str, components: DataFrame, name: str, key: str, description: str,
                   counts: DataFrame | None = None) -> DataFrame:
    """(term, name, key, description): the first component whose name contains the term."""
    return first_containing(components, name, terms, term, 1, order=[name, key], carry=[description], counts=counts).drop("rank")


def route_questions(
    questions: DataFrame, key: str, text: str, *, items: DataFrame, item_key: str, item_name: str, item_place: str,
    components: DataFrame, component_key: str, component_name: str, description: str,
    aliases: DataFrame | Sequence[tuple[str, str]] = PLACE_ALIASES, shown: int = SHOWN, card: Sequence[str] = (), **limits: int,
) -> DataFrame:
    """One answer row per question and hit: (key, type, subject, rank, hit_key, hit_name, detail, card...).

    `detail` is a component's description or an item's place. A question without a hit
    keeps one row, of type no_results or empty_query. `items` are those of the item view; of their
    columns those of the card (category, picture, flag) go with every item, and are NULL elsewhere.
    The classified questions are written once, as every kind of answer reads them.
    """
    asked = staged_table(classify_questions(questions, key, text, aliases, **limits), "questions")
    subjects = lambda route: asked.where(F.col("route") == route)

    info = component_info(subjects("component_info"), "subject", components, component_name, component_key, description)
    by_name = first_containing(items, item_name, subjects("name"), "subject", shown,
                               order=[item_name, item_key], carry=[item_place, *card])
    asked_places = subjects("place").select(F.col("subject").alias(item_place)).distinct()
    by_place = merge_top(items.join(asked_places, item_place, "left_semi"), [item_place], [item_name, item_key],
                         shown, salt_on=[item_key], rank_as="rank")

    as_hit = lambda route, subject, rank, k, name, detail: [
        F.lit(route).alias("__route"), F.col(subject).alias("__subject"), rank.cast("int").alias("rank"),
        F.col(k).cast("string").alias("hit_key"), F.col(name).alias("hit_name"), F.col(detail).alias("detail")]
    no_card = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in card]
    hits = (
        info.select(*as_hit("component_info", "subject", F.lit(1), component_key, component_name, description), *no_card)
        .unionByName(by_place.select(*as_hit("place", item_place, F.col("rank"), item_key, item_name, item_place), *card))
        .unionByName(by_name.select(*as_hit("name", "subject", F.col("rank"), item_key, item_name, item_place), *card))
    )
    # few subjects may have most of the questions: these stay where they are if the answers are small
    answered = join_spread(asked, measured(staged_table(hits, "hits")), {"route": "__route", "subject": "__subject"})
    kind = (
        F.when(F.col("route") == "empty_query", "empty_query")
        .when(F.col("rank").isNull(), "no_results")
        .when(F.col("route") == "component_info", "component_info")
        .otherwise("item_list")
    )
    return answered.select(key, kind.alias("type"), "subject", "rank", "hit_key", "hit_name", "detail", *card)


def item_template() -> dict[str, str]:
    """The form that an add question is answered with: one placeholder per submission field."""
    return {name: f"<{name}>" for name in SUBMISSION_FIELDS.names}
