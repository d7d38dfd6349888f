"""Conversation routing and keyword match."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfgrade.functions.text import query_words
from shelfgrade.operators import messages
from shelfgrade.plans import views

from .registry import DOC_CATALOGUE, query

# Themes made of words that occur in the conversations; the first one declared wins.
THEMES = {"place": ["dans", "unter"], "negation": ["nicht", "not "], "article": ["une", "the", "der "], "salt": ["sel"]}

LAST = """WITH last AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS message
  FROM conversations GROUP BY conv_id)"""
WORDS = """list_transform(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: length(w) > 3),
  lambda w: regexp_replace(w, '^[?.,!]+|[?.,!]+$', '', 'g'))[1:4]"""
THEME = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(message), '{w}')" for w in words) + f" THEN '{name}'" for name, words in THEMES.items()
) + " END"

# Brute force: every word of every message against every product.
FOUND = LAST + f""", catalogue AS ({DOC_CATALOGUE})
, asked AS (SELECT conv_id, unnest({WORDS.format('message')}) AS word, generate_subscripts({WORDS.format('message')}, 1) AS word_at FROM last)
, hits AS (SELECT w.word, c.*, row_number() OVER (PARTITION BY w.word ORDER BY nutriscore_grade, doc_id) AS place
   FROM (SELECT DISTINCT word FROM asked) w JOIN catalogue c ON contains(lower(c.product_name), w.word) OR contains(lower(c.body), w.word)
   QUALIFY place <= 3)
, firsts AS (SELECT a.conv_id, a.word_at, a.word, h.* EXCLUDE (word) FROM asked a JOIN hits h ON a.word = h.word
   QUALIFY row_number() OVER (PARTITION BY a.conv_id, h.product_name ORDER BY a.word_at, h.place) = 1)
, found AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY word_at, place) AS position FROM firsts)
"""


def _turns(spark, folder):
    return views.table(spark, folder, "conversations")


def _messages(spark, folder):
    return messages.last_user_message(_turns(spark, folder))


def _catalogue(spark, folder):
    return views.select(spark, folder, DOC_CATALOGUE, ("documents",))


def _found(spark, folder):
    return messages.message_products(
        _messages(spark, folder), _catalogue(spark, folder), ["doc_id"], brand="body"
    )


@query("last_user_message", LAST + " SELECT conv_id, message FROM last")
def last_user_message(spark, folder):
    return _messages(spark, folder)


@query("tokenize_query", f"SELECT conv_id, turn, array_to_string({WORDS.format('text')}, '|') AS words FROM conversations")
def tokenize_query(spark, folder):
    return _turns(spark, folder).select("conv_id", "turn", F.array_join(query_words("text"), "|").alias("words"))


@query("theme_route", LAST + f" SELECT conv_id, {THEME} AS theme FROM last")
def theme_route(spark, folder):
    return messages.theme_route(_messages(spark, folder), themes=THEMES).select("conv_id", "theme")


@query("keyword_match", FOUND + "SELECT conv_id, CAST(position AS INTEGER) AS position, word, doc_id, nutriscore_grade FROM found")
def keyword_match(spark, folder):
    return _found(spark, folder).select("conv_id", "position", "word", "doc_id", "nutriscore_grade")


@query(
    "reply_route",
    FOUND
    + ", firstgrade AS (SELECT conv_id, count(*) AS n, arg_min(nutriscore_grade, position) AS g FROM found GROUP BY conv_id)"
    + f" SELECT last.conv_id, CASE WHEN n > 0 THEN 'products' WHEN {THEME} IS NOT NULL THEN 'theme' ELSE 'generic' END AS reply, CASE WHEN n > 0 THEN NULL ELSE {THEME} END AS theme,"
    + " CASE WHEN g IN ('a', 'b') THEN 'good' WHEN g = 'c' THEN 'moderate' WHEN g IS NOT NULL THEN 'poor' END AS advice, coalesce(n, 0) AS n_products"
    + " FROM last LEFT JOIN firstgrade f ON f.conv_id = last.conv_id",
)
def reply_route(spark, folder):
    return messages.reply_route(_messages(spark, folder), _found(spark, folder), themes=THEMES)


@query(
    "context_block",
    FOUND
    + """, dist AS (SELECT nutriscore_grade AS g, count(*) AS n FROM catalogue GROUP BY 1)
, header AS (SELECT concat('CATALOGUE : ', format('{:,}', CAST(sum(n) AS BIGINT)), ' produits | Distribution : ', string_agg(concat(upper(g), ':', format('{:,}', n)), ' | ' ORDER BY g), '\n') AS h FROM dist)
, lines AS (SELECT conv_id, string_agg(concat('  • ', product_name, ' (', brands, ') — Nutri-Score ', upper(nutriscore_grade), ' (',
   CASE nutriscore_grade WHEN 'a' THEN 'Excellent — Très sain ✅' WHEN 'b' THEN 'Bon — Bonne qualité nutritionnelle 👍' WHEN 'c' THEN 'Moyen — À consommer avec modération ⚠️' WHEN 'd' THEN 'Médiocre — Qualité nutritionnelle faible 👎' WHEN 'e' THEN 'Mauvais — À éviter ❌' END,
   ')\n    Énergie: ', printf('%.0f', energy_100g), ' kcal | Sucres: ', printf('%.1f', sugars_100g), 'g | Sel: ', printf('%.2f', salt_100g), 'g | Graisses: ', printf('%.1f', fat_100g),
   'g | Protéines: ', printf('%.1f', coalesce(proteins_100g, 0)), 'g | Additifs: ', additives_n, '\n'), '' ORDER BY position) AS t FROM found GROUP BY conv_id)
SELECT last.conv_id, concat(h, CASE WHEN t IS NOT NULL THEN concat('\nPRODUITS TROUVÉS DANS LA BASE :\n', t) ELSE '' END) AS context FROM header, last LEFT JOIN lines ON lines.conv_id = last.conv_id""",
)
def context_block(spark, folder):
    asked = _messages(spark, folder)
    return messages.context_blocks(asked, _found(spark, folder), _catalogue(spark, folder))
