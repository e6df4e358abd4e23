"""Text quality, reuse and diversity."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymill.functions.columns import normalize_question
from waymill.operators import similarity, texts
from waymill.plans.base import Queries

QUERIES = Queries()


@QUERIES.add("x1_surface_gate", "SELECT doc_id, length(text) BETWEEN 30 AND 500 AS length_ok, NOT regexp_matches(text, '[{}`]') AS artifact_free FROM documents")
def x1(t):
    return t("documents").select("doc_id", F.char_length("text").between(30, 500).alias("length_ok"), (~F.col("text").rlike("[{}`]")).alias("artifact_free"))


@QUERIES.add("x4_numbers", """WITH n AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS own FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS x FROM documents) GROUP BY doc_id), p AS (SELECT doc_id, coalesce(own, '') AS own, lag(coalesce(own, '')) OVER (PARTITION BY source, lang ORDER BY doc_id) AS before FROM documents LEFT JOIN n USING (doc_id))
SELECT doc_id, own = before AS equal FROM p WHERE before IS NOT NULL""")
def x4(t):
    """Each document as the rewrite of the one before it in its source and language: whether both hold the same numbers, as often."""
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    d = t("documents").withColumn("own", texts.numbers(F.col("text"))).withColumn("before", F.lag("own").over(w))
    return d.filter("before is not null").select("doc_id", (F.col("own") == F.col("before")).alias("equal"))


@QUERIES.add("x8_scope", "SELECT doc_id, regexp_matches(text, '(^|[^a-z])(all|every|each|that|this)([^a-z]|$)') AS scoped FROM documents")
def x8(t):
    return t("documents").select("doc_id", F.col("text").rlike("(^|[^a-z])(all|every|each|that|this)([^a-z]|$)").alias("scoped"))


@QUERIES.add("x11_normalized_dedup", "SELECT doc_id, md5(k) AS key_hash FROM (SELECT doc_id, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS k FROM documents) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1")
def x11(t):
    return t("documents").groupBy(F.md5(normalize_question(F.col("text"))).alias("key_hash")).agg(F.min("doc_id").alias("doc_id"))


@QUERIES.add("x12_benchmark_reuse", "WITH b AS (SELECT DISTINCT trim(x) AS x FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark) WHERE trim(x) <> ''), l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents) SELECT doc_id, count(DISTINCT x) AS n FROM l WHERE x IN (SELECT x FROM b) GROUP BY doc_id")
def x12(t):
    """Documents that hold a benchmark text as one of their lines, word for word, and how many."""
    line = lambda df: df.withColumn("x", F.explode(F.split("text", "\n"))).withColumn("h", F.sha2(F.trim("x"), 256)).filter(F.trim("x") != "")
    hit = line(t("documents")).select("doc_id", "h").join(line(t("benchmark")).select("h"), "h", "left_semi")
    return hit.groupBy("doc_id").agg(F.countDistinct("h").alias("n"))


@QUERIES.add("x13_near_duplicates")
def x13(t):
    """Near copies among the user turns: class, links and best ratio of each distinct text."""
    c = t("conversations").filter("role = 'user'").withColumn("id", F.col("conv_id") * 10_000 + F.col("turn"))
    return similarity.near_duplicates(c, "id", "text")


@QUERIES.add("x13_shingle_jaccard", """WITH u AS (SELECT text, min(conv_id * 10000 + turn) AS id FROM conversations WHERE role <> 'system' AND length(text) >= 4 GROUP BY text), s AS (SELECT DISTINCT id, substr(text, CAST(i AS BIGINT), 4) AS g FROM u, unnest(range(1, length(text) - 2)) r(i)), z AS (SELECT id, count(*) AS n FROM s GROUP BY id)
SELECT a.id AS a, b.id AS b, round(count(*) / (za.n + zb.n - count(*)), 6) AS jaccard FROM s a JOIN s b ON a.g = b.g AND a.id < b.id JOIN z za ON za.id = a.id JOIN z zb ON zb.id = b.id GROUP BY a.id, b.id, za.n, zb.n HAVING count(*) * 100 >= 25 * (za.n + zb.n - count(*))""")
def x13_jaccard(t):
    """Pairs of different turns of users and assistants whose 4-character shingles have a Jaccard similarity of 0.25 or more, by rare prefixes."""
    c = t("conversations").filter("role <> 'system'").groupBy("text").agg(F.min(F.col("conv_id") * 10_000 + F.col("turn")).alias("id"))
    return similarity.jaccard_pairs(c, "id", "text", percent=25)


@QUERIES.add("x14_opening_concentration", "SELECT lang, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, round(max(n) / sum(n), 6) AS share FROM (SELECT lang, substr(text, 1, 20) AS opening, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def x14(t):
    o = t("documents").groupBy("lang", F.substring("text", 1, 20).alias("opening")).agg(F.count("*").alias("n"))
    return o.groupBy("lang").agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@QUERIES.add("x15_length_stats", "SELECT source, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def x15(t):
    n = F.char_length("text")
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("chars"))


@QUERIES.add("x16_diversity_report", """WITH o AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(month(o_orderdate) AS VARCHAR) AS month, c_mktsegment AS segment, n_name AS nation, r_name AS region, CAST(o_custkey % 25 AS VARCHAR) AS origin, CAST(o_orderkey % 25 AS VARCHAR) AS destination FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
u AS (UNPIVOT o ON status, priority, year, month, segment, nation, region, origin, destination INTO NAME dim VALUE value)
SELECT dim, value, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 'directed', origin || '>' || destination, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'undirected', least(origin, destination) || '-' || greatest(origin, destination), count(*) FROM o GROUP BY 2
UNION ALL SELECT 'signature', 'distinct', count(DISTINCT (status, priority, year, month, segment, nation)) FROM o UNION ALL SELECT 'pair', status || '+' || priority, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'pair', segment || '+' || priority, count(*) FROM o GROUP BY 2""")
def x16(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = j.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("string").alias("year"), F.month("o_orderdate").cast("string").alias("month"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), (F.col("o_custkey") % 25).cast("string").alias("origin"), (F.col("o_orderkey") % 25).cast("string").alias("destination"))
    return texts.diversity(o, [*o.columns], ("origin", "destination"), [("status", "priority"), ("segment", "priority")], ["status", "priority", "year", "month", "segment", "nation"])


@QUERIES.add("x20_comparison_contract", "SELECT doc_id, contains(text, 'the') AND contains(text, 'and') AND contains(text, 'of') AS fulfilled FROM documents")
def x20(t):
    return t("documents").select("doc_id", (F.contains("text", F.lit("the")) & F.contains("text", F.lit("and")) & F.contains("text", F.lit("of"))).alias("fulfilled"))


@QUERIES.add("t2_span_check", "WITH w AS (SELECT conv_id, turn, text AS query, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), s AS (SELECT *, regexp_extract(query, '[^ ]{4,}') AS source_text, strpos(query, regexp_extract(query, '[^ ]{4,}')) - 1 + turn % 2 AS start FROM w) SELECT conv_id, turn, start >= 0 AND length(source_text) > 0 AND substr(query, CAST(start + 1 AS BIGINT), length(source_text)) = source_text AS ok FROM s")
def t2(t):
    """Spans of each turn's first long word; those of odd turns are off by one, and must be found wrong."""
    word = F.regexp_extract("text", "[^ ]{4,}", 0)
    spans = t("conversations").select("conv_id", "turn", F.col("text").alias("query"), word.alias("source_text"), (F.position(word, F.col("text")) - 1 + F.col("turn") % 2).alias("start"))
    return spans.select("conv_id", "turn", texts.span_ok(F.col("query"), F.col("start"), F.col("start") + F.length("source_text"), F.col("source_text")).alias("ok"))


@QUERIES.add("x10_introduced_entities", """WITH c AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS e FROM conversations), k AS (SELECT conv_id, list(DISTINCT x) AS known FROM (SELECT conv_id, unnest(e) AS x FROM c WHERE role <> 'assistant') GROUP BY conv_id)
SELECT conv_id, turn, coalesce(list_aggregate(list_sort(list_filter(e, lambda x: NOT list_contains(coalesce(known, []), x))), 'string_agg', ','), '') AS introduced FROM c LEFT JOIN k USING (conv_id) WHERE role = 'assistant'""")
def x10(t):
    """Entities of answers that no other turn of the conversation names."""
    c = t("conversations").withColumn("e", F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"))))
    known = c.filter("role <> 'assistant'").select("conv_id", F.explode("e").alias("x")).groupBy("conv_id").agg(F.collect_set("x").alias("known"))
    j = c.filter("role = 'assistant'").join(known, "conv_id", "left")
    return j.select("conv_id", "turn", J(texts.introduced_entities(F.col("text"), "[A-Z][a-z]{3,}", F.coalesce("known", F.array().cast("array<string>")))).alias("introduced"))


@QUERIES.add("x17_alignment_gates", "SELECT count(*) >= 100 AS enough, count(*) = count(DISTINCT doc_id) AS unique_ids, count(DISTINCT lang) = 4 AS all_languages, max(n_chars) <= 1000000 AS within_length FROM documents")
def x17(t):
    return t("documents").agg((F.count("*") >= 100).alias("enough"), (F.count("*") == F.countDistinct("doc_id")).alias("unique_ids"), (F.countDistinct("lang") == 4).alias("all_languages"), (F.max("n_chars") <= 1000000).alias("within_length"))


LITERALS = ["the", "und", "les", "una"]
J = lambda a: F.array_join(a, ",")


@QUERIES.add("x2_protected_literals", "SELECT doc_id, array_to_string(list_filter(['the', 'und', 'les', 'una'], lambda x: NOT contains(text, x)), ',') AS missing FROM documents")
def x2(t):
    return t("documents").select("doc_id", J(texts.missing_literals(F.col("text"), F.array(*map(F.lit, LITERALS)))).alias("missing"))


@QUERIES.add("x3_name_guard", "SELECT doc_id, array_to_string(list_filter(['the', 'und', 'les', 'una'], lambda x: contains(text, x) AND x <> CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'und' WHEN 'fr' THEN 'les' ELSE 'una' END), ',') AS foreign_names FROM documents")
def x3(t):
    own = F.when(F.col("lang") == "en", "the").when(F.col("lang") == "de", "und").when(F.col("lang") == "fr", "les").otherwise("una")
    return t("documents").select("doc_id", J(texts.foreign_names(F.col("text"), LITERALS, F.array(own))).alias("foreign_names"))


@QUERIES.add("x5_mention_coverage", "SELECT doc_id, x AS literal, CAST((length(text) - length(replace(text, x, ''))) / length(x) AS BIGINT) AS n, strpos(text, x) AS first FROM documents, (VALUES ('the'), ('und'), ('les'), ('una')) v(x)")
def x5(t):
    return t("documents").select("doc_id", F.inline(texts.mentions(F.col("text"), F.array(*map(F.lit, LITERALS)))))


@QUERIES.add("x6_polarity", "SELECT doc_id, CASE source WHEN 'web' THEN contains(text, 'not') OR contains(text, 'nicht') WHEN 'news' THEN contains(text, 'all') OR contains(text, 'tous') ELSE true END AS polarity_ok FROM documents")
def x6(t):
    return t("documents").select("doc_id", texts.polarity_ok(F.col("text"), F.col("source"), {"web": ["not", "nicht"], "news": ["all", "tous"]}).alias("polarity_ok"))


@QUERIES.add("x9_number_forms", "SELECT conv_id, turn, role, turn % 100 AS n, count(*) FILTER (WHERE contains(text, CAST(turn % 100 AS VARCHAR)) OR (turn % 100 = 1 AND contains(text, '一'))) > 0 AS stated FROM conversations GROUP BY conv_id, turn, role")
def x9(t):
    c = t("conversations").withColumn("n", F.col("turn") % 100)
    forms = texts.number_forms(c, "n")
    j = c.join(forms, c.n == forms.value, "left")
    return j.groupBy("conv_id", "turn", "role", "n").agg(F.coalesce(F.bool_or(F.contains("text", F.col("form"))), F.lit(False)).alias("stated"))


X18 = """e AS (SELECT conv_id, turn, role, text, NOT length(text) BETWEEN 20 AND 400 AS a, len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: NOT list_contains(coalesce(seen, []), x))) > 0 AS b, NOT contains(text, 'a') AS c
 FROM (SELECT *, flatten(list(regexp_extract_all(text, '[0-9]+')) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS seen FROM conversations) WHERE role = 'assistant'),
f AS (SELECT *, regexp_matches(text, '(?i)\\b(result shows|results show|was found|returned)\\b') AS d FROM e)"""


def rationales(t):
    """Answers as rationales; the numbers of a conversation's earlier turns are the seen ones."""
    c = t("conversations").withColumn("own", F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"))))
    number = c.select("conv_id", "turn", F.explode("own").alias("x"))
    first = number.groupBy("conv_id", "x").agg(F.min("turn").alias("first"))  # once a number, however often it is said
    known = number.distinct().join(first, ["conv_id", "x"]).filter("first < turn").groupBy("conv_id", "turn").agg(F.collect_set("x").alias("seen"))
    a = c.filter("role = 'assistant'").join(known, ["conv_id", "turn"], "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    return a.select("conv_id", "turn", "text", texts.rationale_errors(F.col("text"), F.col("seen"), F.array(F.lit("a"))).alias("errors"))


@QUERIES.add("x18_rationale_validation", f"WITH {X18} SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN a THEN 'length' END, CASE WHEN b THEN 'unseen_number' END, CASE WHEN d THEN 'premature_result' END, CASE WHEN c THEN 'missing_word' END], lambda x: x IS NOT NULL), ',') AS errors FROM f")
def x18(t):
    return rationales(t).select("conv_id", "turn", J(F.col("errors")).alias("errors"))


@QUERIES.add("x19_rationale_choice", f"WITH {X18} SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE a OR b OR c OR d) AS n_template, CASE WHEN count(*) FILTER (WHERE a OR b OR c OR d) = 0 THEN 'accepted' WHEN count(*) FILTER (WHERE a OR b OR c OR d) < count(*) THEN 'partial' ELSE 'full' END AS outcome FROM f GROUP BY conv_id")
def x19(t):
    return texts.choose_rationale(rationales(t), "conv_id")
