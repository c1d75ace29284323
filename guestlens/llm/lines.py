"""Recurring lines, found by a log-template tree and dropped, in DataFrame operations.

A line's tokens with a digit become a wildcard.  The tree has a fixed depth: lines are parsed by their number of tokens,
then by their first ``DEPTH`` tokens.  A leaf is split into templates by its other tokens: one that stands at its place in
enough unrelated documents is fixed, any other is a variable field, and lines with the same fixed tokens are a template.
Lines of no recurring template are split once more, by what is frequent among themselves, so that a value that is frequent
in another template can be variable in theirs.  So a leaf holds any number of templates.

A template recurs if it stands in ``DOCUMENTS`` unrelated documents.  Copies of a document repeat all of its lines, which
is no reason to drop them (another operator removes copies).  So each line's document is told by the ``SKETCH`` least hashes
of the word pairs in its other lines: of these by the one that most texts have, or a more common one that stands beside it in
another text.  Near copies of one document share it however many they are, unless all of their hashes differ.  How many
copies come besides never matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from guestlens.llm.common import discard, stored
from guestlens.plans.search import small_enough

WILDCARD = "<*>"
DEPTH = 3
#: A template has at least this share of fixed places.
ALIKE = 0.6
DOCUMENTS = 10
SKETCH = 8
#: Digits of a pair's hash.
HASH = 16
#: Rounds of splitting a leaf.
ROUNDS = 2
#: Shorter lines ("And.") recur by chance and stay.
LEAST_TOKENS = 3
#: A word of 8 letters or more and its successor.
WORD_PAIR = "[^ ]{8,}( [^ ]+)?"

DIGIT_TOKEN = r"[^ ]*[0-9][^ ]*"


def single_blanks(line: Column) -> Column:
    several = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
    return F.trim(F.when(several, F.regexp_replace(line, r"[ \t\r]+", " ")).otherwise(line))


def without_digits(line: Column) -> Column:
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, DIGIT_TOKEN, WILDCARD)).otherwise(line)


def masked_lines(text: Column) -> Column:
    """The lines as tokens between single blanks, those with a digit as wildcards."""
    return F.transform(F.transform(F.split(text, "\n", -1), single_blanks), without_digits)


def text_ids(text: str) -> list[Column]:
    """128 bits that equal texts share."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def sketched(lines: str) -> Column:
    """The least hashes of a text's pairs of a long word and its successor, each with the first line that has it."""
    def pairs(line: Column, i: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(WORD_PAIR), F.lit(0))
        return F.transform(found, lambda pair: F.named_struct(F.lit("key"), F.left(F.md5(pair), F.lit(HASH)), F.lit("line"), i))

    return F.slice(F.array_sort(F.flatten(F.transform(lines, pairs))), 1, SKETCH)


def documents_of(lines: DataFrame) -> DataFrame:
    """(t1, t2, told): for each text its sketch, with the number of texts that have each hash."""
    texts = lines.where("place = 0").groupBy("t1", "t2").agg(F.first("sketch").alias("sketch"))
    once = F.filter("sketch", lambda s, i: (i == 0) | (s["key"] != F.get("sketch", i - 1)["key"]))
    keys = texts.select("t1", "t2", F.explode(once).alias("s")).select("t1", "t2", "s.key", "s.line")
    common = keys.groupBy("key").agg(F.count("*").alias("n"))
    counted = keys.join(common, "key").withColumn("best", F.max(F.struct("n", "key")).over(W.partitionBy("t1", "t2")))
    # A hash goes with the most common one that stands beside it in any text.
    leading = counted.where("n > 1").groupBy("key").agg(F.max("best")["key"].alias("lead"))
    led = counted.join(leading, "key", "left").withColumn("lead", F.coalesce("lead", "best.key"))
    return led.groupBy("t1", "t2").agg(F.collect_list(F.struct("n", "key", "line", "lead")).alias("told"))


def split_leaf(forms: DataFrame, seen: DataFrame) -> DataFrame:
    """(leaf, hash, pattern): the template of each form that has enough fixed places.

    ``forms`` (leaf, hash, tokens) are the lines of the leaves, ``seen`` (leaf, hash, document) the documents that have them.
    """
    tokens = forms.select("leaf", "hash", F.posexplode("tokens").alias("place", "token"))
    held = seen.join(tokens, ["leaf", "hash"]).select("leaf", "place", "token", "document").distinct()
    fixed = held.groupBy("leaf", "place", "token").agg(F.count("*").alias("n")).where(F.col("n") >= DOCUMENTS).drop("n")
    places = F.array_sort(F.collect_list(F.struct("place", "token")))
    found = tokens.join(fixed, ["leaf", "place", "token"]).groupBy("leaf", "hash").agg(places.alias("fixed"))
    enough = found.join(forms.select("leaf", "hash", F.size("tokens").alias("size")), ["leaf", "hash"]).where(F.size("fixed") >= ALIKE * F.col("size"))
    return enough.select("leaf", "hash", F.xxhash64("fixed").alias("pattern"))


def recurring_lines(docs: DataFrame, text: str) -> DataFrame:
    """(t1, t2, gone): the places of the lines that are to be dropped, for texts that have any."""
    split = docs.where(F.col(text).isNotNull()).select(*text_ids(text), masked_lines(F.col(text)).alias("lines"))
    marked = split.select("t1", "t2", "lines", sketched("lines").alias("sketch"))
    # Only the first line of a text carries its sketch.
    first = F.transform("lines", lambda line, i: F.named_struct(F.lit("place"), i, F.lit("line"), line, F.lit("sketch"), F.when(i == 0, F.col("sketch"))))
    each = marked.select("t1", "t2", F.explode(first).alias("l")).select("t1", "t2", "l.place", "l.line", "l.sketch", F.split("l.line", " ").alias("tokens"))
    leaf = F.when(F.size("tokens") >= LEAST_TOKENS, F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)))
    told = each.select("t1", "t2", "place", leaf.alias("leaf"), "line", "sketch").where("leaf IS NOT NULL OR place = 0")
    lines = stored(told.withColumn("line", F.when(F.col("leaf").isNotNull(), F.col("line"))), "lines")

    often = lines.where("leaf IS NOT NULL").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= DOCUMENTS).select("leaf")
    often = small_enough(stored(often, "line-leaves"), 16)
    candidates = lines.drop("sketch").join(often, "leaf", "left_semi").withColumn("hash", F.xxhash64("line"))
    others = F.filter("told", lambda k: k["line"] != F.col("place"))
    # The line itself must not tell the document, not even through what stands beside it elsewhere.
    inside = F.transform(F.filter("told", lambda k: k["line"] == F.col("place")), lambda k: k["key"])
    best = F.array_max(F.transform(others, lambda k: F.named_struct(F.lit("n"), k["n"], F.lit("key"), k["key"], F.lit("lead"), k["lead"])))
    document = F.coalesce(F.when(F.array_contains(inside, best["lead"]), best["key"]).otherwise(best["lead"]), F.lit(""))
    told = candidates.join(documents_of(lines), ["t1", "t2"], "left").withColumn("document", F.xxhash64(document)).drop("told")
    candidates = stored(told, "line-candidates")
    discard(lines)

    seen = candidates.select("leaf", "hash", "document").distinct()
    enough = seen.select("leaf", "document").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= DOCUMENTS).select("leaf")
    seen = stored(seen.join(enough, "leaf", "left_semi"), "line-documents")
    forms = candidates.join(enough, "leaf", "left_semi").groupBy("leaf", "hash").agg(F.max("line").alias("line"))
    forms = stored(forms.select("leaf", "hash", F.split("line", " ").alias("tokens")), "line-forms")
    patterns = None
    for turn in range(ROUNDS):
        left = forms if patterns is None else forms.join(good, ["leaf", "hash"], "left_anti")
        more = split_leaf(left, seen if patterns is None else seen.join(good, ["leaf", "hash"], "left_anti"))
        old = patterns.join(good, ["leaf", "hash"], "left_semi") if patterns is not None else None
        patterns = stored(more if old is None else old.unionByName(more), "line-patterns")
        met = seen.join(patterns, ["leaf", "hash"]).select("leaf", "pattern", "document").distinct()
        recurring = met.groupBy("leaf", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= DOCUMENTS)
        good = patterns.join(recurring, ["leaf", "pattern"], "left_semi").select("leaf", "hash")
    return candidates.join(good, ["leaf", "hash"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("place").alias("gone"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` without the lines of recurring templates, and with the ``counts`` of its lines and of those dropped.

    Lines end at line feeds.  All columns and rows are kept, in any number of copies; columns already named like
    ``counts`` are replaced.  A null text stays null and has no lines, an empty text has one empty line; a text of
    which no line is left becomes empty.  Lines of fewer than three tokens are never dropped.  All lines without a long word
    in the other lines of their text count as of one document.  Null keys and repeated rows need no care, as documents are
    told apart by their texts only; an empty table stays empty.
    """
    gone = recurring_lines(docs, text)
    names = [c for c in docs.columns if c not in counts]
    packed = docs.select(F.struct(*(f"`{c}`" for c in names)).alias("row"), *text_ids(text))
    joined = packed.join(gone, ["t1", "t2"], "left")
    lines = F.split(F.col("row")[text], "\n", -1)
    left = F.filter(lines, lambda l, i: ~F.array_contains("gone", i))
    out = joined.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    count = F.when(F.col("row")[text].isNull(), 0).otherwise(F.size(lines))
    new_text = F.when(F.col("left").isNull(), F.col("row")[text]).otherwise(F.array_join("left", "\n"))
    return out.select(
        *(new_text.alias(c) if c == text else F.col("row")[c].alias(c) for c in names),
        count.cast("long").alias(counts[0]),
        F.when(F.col("left").isNull(), 0).otherwise(count - F.size("left")).cast("long").alias(counts[1]),
    )


def lines_sql(table: str = "documents", text: str = "text") -> str:
    """The same in DuckDB's SQL: doc_id, n_lines, n_dropped, text."""
    form = f"regexp_replace(trim(regexp_replace(l, '[ \\t\\r]+', ' ', 'g'), ' '), '{DIGIT_TOKEN}', '{WILDCARD}', 'g')"
    words = "string_split(line, ' ')"

    def turn(k: int, forms: str, seen: str) -> str:
        return f"""
tokens{k} AS (SELECT n, lead, line, unnest({words}) AS token, generate_subscripts({words}, 1) AS place FROM {forms}),
fixed{k} AS (SELECT n, lead, place, token FROM {seen} JOIN tokens{k} USING (n, lead, line) GROUP BY ALL HAVING count(DISTINCT document) >= {DOCUMENTS}),
more{k} AS (SELECT n, lead, line, list(place || ':' || token ORDER BY place) AS pattern FROM tokens{k} SEMI JOIN fixed{k} USING (n, lead, place, token)
  GROUP BY n, lead, line HAVING count(*) >= {ALIKE} * n),
patterns{k} AS ({f"SELECT * FROM patterns{k - 1} SEMI JOIN good{k - 1} USING (n, lead, line) UNION ALL " if k else ""}SELECT * FROM more{k}),
recurring{k} AS (SELECT n, lead, pattern FROM seen JOIN patterns{k} USING (n, lead, line) GROUP BY ALL HAVING count(DISTINCT document) >= {DOCUMENTS}),
good{k} AS (SELECT n, lead, line FROM patterns{k} SEMI JOIN recurring{k} USING (n, lead, pattern)),
forms{k} AS (SELECT * FROM forms ANTI JOIN good{k} USING (n, lead, line)),
left{k} AS (SELECT * FROM seen ANTI JOIN good{k} USING (n, lead, line)),"""

    turns = "".join(turn(k, f"forms{k - 1}" if k else "forms", f"left{k - 1}" if k else "seen") for k in range(ROUNDS))
    return f"""
WITH texts AS (SELECT DISTINCT {text} AS t FROM {table} WHERE {text} IS NOT NULL),
split AS (SELECT t, list_transform(string_split(t, chr(10)), lambda l: {form}) AS lines FROM texts),
numbered AS (SELECT t, unnest(string_split(t, chr(10))) AS raw, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
words AS (SELECT t, i, unnest(regexp_extract_all(line, '{WORD_PAIR}')) AS pair FROM numbered),
pairs AS (SELECT t, left(md5(pair), {HASH}) AS key, min(i) AS i, count(*) AS times FROM words GROUP BY t, key),
spread AS (SELECT t, key, i, sum(times) OVER (PARTITION BY t ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pairs),
counted AS (SELECT t, key, i, count(*) OVER (PARTITION BY key) AS texts FROM spread WHERE coalesce(before, 0) < {SKETCH}),
best AS (SELECT t, max({{'n': texts, 'key': key}}) AS b FROM counted GROUP BY t),
leaders AS (SELECT key, (max(b)).key AS lead FROM counted JOIN best USING (t) GROUP BY key),
sketch AS (SELECT * FROM counted JOIN leaders USING (key)),
lines AS (SELECT t, i, line, len({words}) AS n, {words}[1:{DEPTH}] AS lead FROM numbered WHERE len({words}) >= {LEAST_TOKENS}),
told AS (SELECT l.t, l.i, l.line, l.n, l.lead, coalesce(arg_max(coalesce(own.key, s.lead), {{'n': s.texts, 'key': s.key}}), '') AS document
  FROM lines l LEFT JOIN sketch s ON s.t = l.t AND s.i <> l.i
  LEFT JOIN (SELECT o.t, o.i, o.key AS lead, x.key FROM sketch o JOIN sketch x ON x.t = o.t AND x.lead = o.key AND x.i <> o.i) own
  ON own.t = l.t AND own.i = l.i AND own.lead = s.lead AND own.key = s.key GROUP BY ALL),
seen AS (SELECT DISTINCT n, lead, line, document FROM told),
forms AS (SELECT DISTINCT n, lead, line FROM seen),{turns}
kept AS (SELECT b.t, count(*) AS n_lines, count(g.line) AS n_dropped,
  coalesce(string_agg(raw, chr(10) ORDER BY b.i) FILTER (WHERE g.line IS NULL), '') AS new_text
  FROM numbered b LEFT JOIN good{ROUNDS - 1} g ON g.line = b.line GROUP BY b.t)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, new_text AS text
FROM {table} LEFT JOIN kept ON kept.t = {table}.{text}"""
