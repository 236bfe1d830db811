"""A table of questions: how each is answered, and the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.operators.matching import first_containing
from kartoteka.operators.project import item_view
from kartoteka.operators.routing import (
    ADD_WORDS,
    INFO_PHRASES,
    PLACE_ALIASES,
    SHOWN,
    classify_chat,
    classify_questions,
    component_info,
    detect_place,
    extract_term,
    normalised,
    route_questions,
)
from kartoteka.registry.base import Query, table

# A question per part, written so that both engines read it.
ASKED = """CASE p_partkey % 9
    WHEN 0 THEN concat('  What is the ', p_name, ' ingredient ')
    WHEN 1 THEN concat('tell me about ', split_part(p_name, ' ', 2))
    WHEN 2 THEN concat(' ', chr(10), ' ')
    WHEN 3 THEN concat('Give me Nation_', CAST(p_partkey % 29 AS VARCHAR(20)), ' dishes')
    WHEN 4 THEN upper(p_name)
    WHEN 5 THEN split_part(p_name, ' ', 2)
    WHEN 6 THEN concat('describe leather ', p_name)
    WHEN 7 THEN concat('Add a new ', p_name)
    ELSE concat('haddock, what is what is the ', split_part(p_name, ' ', 1)) END"""

# Items: parts with a place of which two are not on the list.
ITEMS_SQL = """
    SELECT p_partkey AS id, p_name AS name, n_name AS area, s_name AS category, p_type AS thumbnail, n_regionkey AS flag
    FROM part JOIN nation ON p_partkey % 27 = n_nationkey LEFT JOIN supplier ON p_partkey = s_suppkey
"""


def asked(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("question_id"), F.expr(ASKED).alias("text"))


def part_items(spark, folder) -> DataFrame:
    part = table(spark, folder, "part").withColumn("place", F.col("p_partkey") % 27)
    return item_view(part, table(spark, folder, "supplier"), table(spark, folder, "nation"),
                     category_key=("p_partkey", "s_suppkey"), place_key=("place", "n_nationkey"),
                     columns={"id": "i.p_partkey", "name": "i.p_name", "area": "p.n_name", "category": "c.s_name", "thumbnail": "i.p_type",
                              "flag": "p.n_regionkey"})


CARD = ["category", "thumbnail", "flag"]


def aliases(spark, folder) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("rank"), F.col("n_name").alias("alias"), F.col("n_name").alias("place"))


def components(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type").alias("description"))


def classified(spark, folder):
    return classify_questions(asked(spark, folder), "question_id", "text", aliases(spark, folder))


def chats(spark, folder):
    return asked(spark, folder).select("question_id", classify_chat("text").alias("route"))


def chats_in_conversations(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.where("role = 'user'").select("conv_id", "turn", classify_chat("text").alias("route"))


def terms(spark, folder):
    return asked(spark, folder).select("question_id", extract_term(normalised("text")).alias("term"))


def places(spark, folder):
    return detect_place(asked(spark, folder), "question_id", "text", aliases(spark, folder)).select("question_id", "place")


def places_in_blocks(spark, folder):
    """The same with a limit so low that questions and aliases meet by grams."""
    found = detect_place(asked(spark, folder), "question_id", "text", aliases(spark, folder), max_listed=9)
    return found.select("question_id", "place")


def listed_places(spark, folder):
    """Places named in whole documents, by the fixed list; few of them name one."""
    return detect_place(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", PLACE_ALIASES).select("doc_id", "place")


def words_in_documents(spark, folder):
    """Whole documents with the first listed word of another table that they contain, of as many as there are suppliers and passages."""
    words = table(spark, folder, "benchmark").select(F.col("item_id").alias("rank"), F.expr("split_part(text, ' ', 3)").alias("word"))
    words = words.where(F.length("word") > 4)
    return detect_place(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text",
                        words.select("rank", F.col("word").alias("alias"), F.col("word").alias("place")), max_listed=0).select("doc_id", "place")


def named_items(spark, folder):
    """Word and name searches over customers, whose names all look alike."""
    sought = table(spark, folder, "supplier").select(F.expr("substring(s_name, 15, 4)").alias("term")).unionByName(
        table(spark, folder, "part").select(F.expr("upper(split_part(p_name, ' ', 1))").alias("term")))
    customer = table(spark, folder, "customer")
    return first_containing(customer, "c_name", sought, "term", 3, order=["c_name", "c_custkey"])


def info(spark, folder):
    sought = table(spark, folder, "part").select(F.expr("split_part(p_name, ' ', 2)").alias("term"))
    return component_info(sought, "term", components(spark, folder), "p_name", "p_partkey", "description")


def routed(spark, folder):
    return _routed(spark, folder)


def routed_in_blocks(spark, folder):
    return _routed(spark, folder, max_listed=4)


def _routed(spark, folder, **limits):
    return route_questions(
        asked(spark, folder), "question_id", "text",
        items=part_items(spark, folder), item_key="id", item_name="name", item_place="area",
        components=components(spark, folder), component_key="p_partkey", component_name="p_name",
        description="description", aliases=aliases(spark, folder), card=CARD, **limits)


_QUERY = f"SELECT p_partkey AS question_id, trim(lower({ASKED}), ' ' || chr(9) || chr(10)) AS query FROM part"
_HAS_INFO = " OR ".join(f"contains(query, '{p}')" for p in INFO_PHRASES)
_AFTER = "CASE " + " ".join(f"WHEN contains(query, '{p}') THEN string_split(query, '{p}')[-1]" for p in INFO_PHRASES) + " ELSE query END"
_TERM = rf"trim(regexp_replace(regexp_replace({_AFTER}, '\b(the|ingredient)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_PLACE = "(SELECT arg_min(n_name, n_nationkey) FROM nation WHERE contains(query, lower(n_name)))"

CLASSIFIED_SQL = f"""
    SELECT question_id, query, route,
           CASE route WHEN 'component_info' THEN {_TERM} WHEN 'place' THEN place WHEN 'name' THEN query END AS subject
    FROM (SELECT *, CASE WHEN query = '' THEN 'empty_query' WHEN {_HAS_INFO} THEN 'component_info'
                         WHEN place IS NOT NULL THEN 'place' ELSE 'name' END AS route
          FROM (SELECT question_id, query, {_PLACE} AS place FROM ({_QUERY})))
"""

ROUTED_SQL = f"""
    WITH asked AS ({CLASSIFIED_SQL}), items AS ({ITEMS_SQL}),
    info AS (
        SELECT 'component_info' AS route, subject, 1 AS rank, p_partkey AS hit, p_name AS name,
               p_brand || ' ' || p_type AS detail, NULL AS category, NULL AS thumbnail, NULL AS flag
        FROM (SELECT DISTINCT ON (subject) subject, p_partkey, p_name, p_brand, p_type
              FROM (SELECT DISTINCT subject FROM asked WHERE route = 'component_info') a
              JOIN part ON contains(lower(p_name), subject) ORDER BY subject, p_name, p_partkey)),
    place AS (
        SELECT 'place' AS route, area AS subject,
               row_number() OVER (PARTITION BY area ORDER BY name, id) AS rank, id, name, area AS detail, category, thumbnail, flag FROM items),
    named AS (
        SELECT 'name' AS route, subject, row_number() OVER (PARTITION BY subject ORDER BY name, id) AS rank, id, name, area, category, thumbnail, flag
        FROM (SELECT DISTINCT subject FROM asked WHERE route = 'name') a JOIN items ON contains(lower(name), subject)),
    hits AS (SELECT * FROM info UNION ALL SELECT * FROM place UNION ALL SELECT * FROM named)
    SELECT question_id,
           CASE WHEN a.route = 'empty_query' THEN 'empty_query' WHEN rank IS NULL THEN 'no_results'
                WHEN a.route = 'component_info' THEN 'component_info' ELSE 'item_list' END AS type,
           a.subject, rank::INT AS rank, hit::VARCHAR AS hit_key, name AS hit_name, detail, category, thumbnail, flag
    FROM asked a LEFT JOIN (SELECT * FROM hits WHERE rank <= {SHOWN}) h ON a.route = h.route AND a.subject = h.subject
"""

_CHAT = (r"CASE WHEN trim({text}, ' ' || chr(9) || chr(10)) = '' THEN 'empty_query' "
         r"WHEN regexp_matches(lower({text}), '\b(" + "|".join(ADD_WORDS) + r")\b') THEN 'template' ELSE 'item_search' END")

QUERIES = {
    "classify_questions": Query(classified, CLASSIFIED_SQL),
    "classify_chat": Query(chats, f"SELECT p_partkey AS question_id, {_CHAT.format(text=ASKED)} AS route FROM part"),
    "classify_conversations": Query(chats_in_conversations, f"""
        SELECT conv_id, turn, {_CHAT.format(text='text')} AS route FROM conversations WHERE role = 'user'"""),
    "extract_term": Query(terms, f"SELECT question_id, {_TERM} AS term FROM ({_QUERY})"),
    "detect_place": Query(places, f"SELECT question_id, {_PLACE} AS place FROM ({_QUERY})"),
    "detect_place_blocks": Query(places_in_blocks, f"SELECT question_id, {_PLACE} AS place FROM ({_QUERY})"),
    "detect_place_listed": Query(listed_places, f"""
        SELECT doc_id, CASE {" ".join(f"WHEN contains(lower(text), '{a}') THEN '{p}'" for a, p in PLACE_ALIASES)} END AS place FROM documents"""),
    "words_in_documents": Query(words_in_documents, """
        SELECT doc_id, (SELECT arg_min(word, (rank, word)) FROM (SELECT item_id AS rank, split_part(text, ' ', 3) AS word FROM benchmark)
                        WHERE length(word) > 4 AND contains(lower(text), lower(word))) AS place FROM documents"""),
    "name_search": Query(named_items, """
        SELECT term, rank::INT AS rank, c_name, c_custkey FROM (
            SELECT term, c_name, c_custkey, row_number() OVER (PARTITION BY term ORDER BY c_name, c_custkey) AS rank
            FROM (SELECT substr(s_name, 15, 4) AS term FROM supplier
                  UNION SELECT lower(split_part(p_name, ' ', 1)) FROM part) t
            JOIN customer ON contains(lower(c_name), term))
        WHERE rank <= 3"""),
    "component_info": Query(info, """
        SELECT DISTINCT ON (term) term, p_name, p_partkey, p_brand || ' ' || p_type AS description
        FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS term FROM part) JOIN part ON contains(lower(p_name), term)
        ORDER BY term, p_name, p_partkey"""),
    "route_questions": Query(routed, ROUTED_SQL),
    "route_questions_blocks": Query(routed_in_blocks, ROUTED_SQL),
}
