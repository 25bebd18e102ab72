"""Queries of the text functions (section C of the survey) and of simple predicates (section B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.plans.projections import logical, with_tables
from kbspark.plans.registry import query

TOKEN_SQL = r"[\p{L}\p{N}]+(?:[._/\-][\p{L}\p{N}]+)*"


@query("a1_table_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(spark, d):
    return logical(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id")


@query("a19_fingerprint", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return logical(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("c1_normalize", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5 FROM documents")
def _(spark, d):
    return logical(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("text_md5"))


@query("c2_tokenize", rf"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{TOKEN_SQL}'), lambda x: CASE WHEN regexp_full_match(x, '[\x00-\x7F]*') THEN lower(x) ELSE x END) AS t FROM documents)")
def _(spark, d):
    return logical(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("c3_canonicalize", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'widget' THEN 'part' WHEN 'small' THEN 'little' ELSE x END), ' ') AS canonical FROM part")
def _(spark, d):
    return logical(spark, d, "part").select("p_partkey", F.array_join(T.canonical(T.tokens(F.col("p_name")), {"widget": "part", "small": "little"}), " ").alias("canonical"))


@query("c4_sentences", "SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[\n]+|[.!?؟;]+'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '') AS s FROM documents))")
def _(spark, d):
    return logical(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text")))).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("sentence"))


@query("c5_parenthetical_tags", with_tables(r"SELECT record_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(mode_text, '\(([^()]*)\)', 1), lambda x: lower(trim(x))))), ',') AS tags FROM record WHERE mode_text IS NOT NULL"))
def _(spark, d):
    return logical(spark, d, "record").where("mode_text is not null").select("record_id", F.array_join(T.parenthetical_tags(F.col("mode_text")), ",").alias("tags"))


@query("c6_char_ngrams", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3)))), ',') AS grams FROM (SELECT p_partkey, replace(p_name, ' ', '') AS t FROM part)")
def _(spark, d):
    return logical(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(T.char_ngrams(F.col("p_name"))), ",").alias("grams"))


@query("c7_strip_non_ascii", r"SELECT doc_id, md5(regexp_replace(text, '[^\x00-\x7F]+', '', 'g')) AS text_md5 FROM documents")
def _(spark, d):
    return logical(spark, d, "documents").select("doc_id", F.md5(T.strip_non_ascii(F.col("text"))).alias("text_md5"))


@query("c8_strip_non_printable", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{A0}]', ' ', 'g'), '[\x{2028}\x{2029}\r]', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g'), '[^\p{L}\p{N}_\s.,!?\-]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS text_md5 FROM pages")
def _(spark, d):
    return logical(spark, d, "pages").select("page_id", F.md5(T.strip_non_printable(F.col("html"))).alias("text_md5"))


@query("c9_thinking_split", r"WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || substr(text, 1, 20) || '</think>' || text WHEN 1 THEN substr(text, 1, 20) || '</think>' || text WHEN 2 THEN text || '<think>' || substr(text, 1, 20) ELSE text END AS x FROM conversations) SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN '' ELSE regexp_replace(CASE turn % 4 WHEN 0 THEN regexp_extract(x, '(?s)<think>(.*?)</think>', 1) WHEN 1 THEN string_split(x, '</think>')[1] ELSE string_split(x, '<think>')[2] END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS thinking, md5(regexp_replace(CASE turn % 4 WHEN 0 THEN string_split(x, '</think>')[2] WHEN 1 THEN string_split(x, '</think>')[2] WHEN 2 THEN string_split(x, '<think>')[1] ELSE x END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS rest_md5 FROM t")
def _(spark, d):
    m = F.col("turn") % 4
    head = F.substring("text", 1, 20)
    x = F.when(m == 0, F.concat(F.lit("<think>"), head, F.lit("</think>"), F.col("text"))).when(m == 1, F.concat(head, F.lit("</think>"), F.col("text"))).when(m == 2, F.concat(F.col("text"), F.lit("<think>"), head)).otherwise(F.col("text"))
    thinking, rest = T.thinking_split(F.col("x"))
    return logical(spark, d, "conversations").withColumn("x", x).select("conv_id", "turn", thinking.alias("thinking"), F.md5(rest).alias("rest_md5"))


@query("c10_flatten_content", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || lower(role) ELSE role END AS flat FROM conversations")
def _(spark, d):
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("role").alias("text")), F.struct(F.lit("text").alias("type"), F.lower("role").alias("text"))))
    return logical(spark, d, "conversations").withColumn("c", F.when(F.col("turn") % 2 == 0, parts).otherwise(F.col("role"))).select("conv_id", "turn", T.flatten_content(F.col("c")).alias("flat"))


WORDS_SQL = r"len(regexp_extract_all(text, '\S+'))"


@query("c11_token_estimate", f"SELECT doc_id, CAST(floor({WORDS_SQL} * 13 / 10) AS BIGINT) AS n_tokens FROM documents")
def _(spark, d):
    return logical(spark, d, "documents").select("doc_id", T.word_estimate(F.col("text")).alias("n_tokens"))


@query("c12_token_cost", f"SELECT lang, round(sum(CAST(floor({WORDS_SQL} * 13 / 10) AS BIGINT)) * 0.150 / 1000000, 9) AS cost FROM documents GROUP BY lang")
def _(spark, d):
    return logical(spark, d, "documents").groupBy("lang").agg(F.sum(T.word_estimate(F.col("text"))).alias("n")).select("lang", F.round(T.token_cost(F.col("n")), 9).alias("cost"))


@query("c13_type_by_extension", r"SELECT page_id, CASE WHEN e IN ('html','htm','xhtml') THEN 'html' WHEN e IN ('md','markdown') THEN 'markdown' WHEN e IN ('txt','php','json','xml') THEN 'plain' END AS kind FROM (SELECT page_id, lower(regexp_extract(split_part(url, '?', 1), '[^/.\\]\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)")
def _(spark, d):
    return logical(spark, d, "pages").select("page_id", T.type_by_extension(F.substring_index("url", "?", 1)).alias("kind"))


HTML_SQL = r"""least(round(0.4 * a + 0.3 * b + 0.1 * least(s, 5 - a - b) + 0.15 * h + 0.1 * c, 6), 1.0) AS score FROM (SELECT page_id, html, CAST(regexp_matches(t, '(?i)<!DOCTYPE\s+html') AS INT) AS a, CAST(regexp_matches(t, '(?i)<html[\s>]') AS INT) AS b,
 CAST(contains(l, '<head') AS INT) + CAST(contains(l, '<body') AS INT) + CAST(contains(l, '<div') AS INT) + CAST(contains(l, '<span') AS INT) + CAST(contains(l, '<p>') AS INT) + CAST(contains(l, '<table') AS INT) + CAST(contains(l, '<form') AS INT) AS s,
 CAST(regexp_matches(t, '(?i)<h[1-6][\s>]') AS INT) AS h, CAST(regexp_matches(t, '</\w+>') AS INT) AS c FROM (SELECT page_id, html, substr(html, 1, 5000) AS t, lower(substr(html, 1, 5000)) AS l FROM pages))"""


@query("c14_html_score", "SELECT page_id, CAST(" + HTML_SQL.replace(" AS score FROM", " AS DOUBLE) AS score FROM", 1))
def _(spark, d):
    return logical(spark, d, "pages").select("page_id", T.html_score(F.col("html")).cast("double").alias("score"))


MD_SQL = r"""SELECT doc_id, CAST(least(round(CASE WHEN a >= 3 THEN 0.35 WHEN a >= 1 THEN 0.2 ELSE 0 END + CASE WHEN b >= 3 THEN 0.15 WHEN b >= 1 THEN 0.08 ELSE 0 END + CASE WHEN q THEN 0.1 ELSE 0 END + CASE WHEN l >= 2 THEN 0.25 WHEN l >= 1 THEN 0.15 ELSE 0 END + CASE WHEN f THEN 0.2 ELSE 0 END + CASE WHEN i THEN 0.1 ELSE 0 END + CASE WHEN o THEN 0.1 ELSE 0 END, 6), 1.0) AS DOUBLE) AS score
 FROM (SELECT doc_id, len(regexp_extract_all(t, '(?m)^#{1,6}\s+.+')) AS a, len(regexp_extract_all(t, '(?m)^[\*\-\+]\s+')) + len(regexp_extract_all(t, '(?m)^\d+\.\s+')) AS b, regexp_matches(t, '(?m)^>\s+') AS q, len(regexp_extract_all(t, '\[.+?\]\(.+?\)')) AS l, regexp_matches(t, '(?m)^```') AS f, regexp_matches(t, '`[^`]+`') AS i, regexp_matches(t, '\*\*.+?\*\*|__.+?__') AS o
 FROM (SELECT doc_id, substr(CASE doc_id % 3 WHEN 0 THEN '# ' || text WHEN 1 THEN '- ' || replace(text, chr(10), chr(10) || '- ') ELSE '> ' || text END, 1, 5000) AS t FROM documents))"""


@query("c15_markdown_score", MD_SQL)
def _(spark, d):
    m = F.col("doc_id") % 3
    t = F.when(m == 0, F.concat(F.lit("# "), F.col("text"))).when(m == 1, F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))).otherwise(F.concat(F.lit("> "), F.col("text")))
    return logical(spark, d, "documents").select("doc_id", T.markdown_score(t).cast("double").alias("score"))


# pages under names that say nothing, plain, Markdown or an unknown type; documents written as in c15, one of eight as a page
@query("c16_content_type", "SELECT doc_id * 2 AS id, CASE WHEN doc_id % 8 = 5 THEN 'html' WHEN score > 0.2 THEN 'markdown' ELSE 'plain' END AS kind FROM (" + MD_SQL + ") UNION ALL SELECT page_id * 2 + 1, CASE WHEN page_id % 4 = 1 THEN 'markdown' WHEN page_id % 4 = 0 THEN CASE WHEN score >= 0.8 THEN 'html' ELSE 'plain' END WHEN score > 0.3 THEN 'html' ELSE 'plain' END FROM (SELECT page_id, " + HTML_SQL + ")")
def _(spark, d):
    m = F.col("doc_id") % 3
    t = F.when(m == 0, F.concat(F.lit("# "), F.col("text"))).when(m == 1, F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))).otherwise(F.concat(F.lit("> "), F.col("text")))
    t = F.when(F.col("doc_id") % 8 == 5, F.concat(F.lit("<!doctype html><html><body><h1>x</h1>"), F.col("text"))).otherwise(t)
    docs = logical(spark, d, "documents").select((F.col("doc_id") * 2).alias("id"), T.content_type(t).alias("kind"))
    n = F.col("page_id") % 4
    path = F.when(n == 0, "a.txt").when(n == 1, "dir/b.MD").when(n == 3, "c.unknown")
    return docs.unionByName(logical(spark, d, "pages").select((F.col("page_id") * 2 + 1).alias("id"), T.content_type(F.col("html"), path).alias("kind")))


@query("c17_error_class", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'authentication' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'configuration' WHEN 3 THEN 'network' WHEN 4 THEN 'context_length' ELSE 'external_service' END AS kind FROM events WHERE event_type = 'error'")
def _(spark, d):
    said = ["HTTP 401 Unauthorized", "Too many requests", "Model not found: x", "the request timed out", "maximum context reached", "payload too large", "something else"]
    message = F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % 7 + 1).cast("int"))
    return logical(spark, d, "events").where("event_type = 'error'").select("event_id", T.error_class(message).alias("kind"))


# from no to six references a text, of all kinds, some of them twice, in front of the whole document
REFS_SQL = "SELECT doc_id, list_transform(range(1, doc_id % 7 + 1), lambda i: CASE (doc_id + i) % 4 WHEN 0 THEN 'source:' WHEN 1 THEN 'note:' ELSE 'source_insight:' END || CAST((doc_id * i) % 5 AS VARCHAR)) AS r FROM documents"
FIRST_SQL = "len(list_filter(range(1, {0} + 1), lambda j: list_position(r, r[j]) = j))"


def cited():
    kind = lambda i: F.element_at(F.array(*map(F.lit, ["source:", "note:", "insight:", "source_insight:"])), ((F.col("doc_id") + i) % 4 + 1).cast("int"))
    refs = F.transform(F.when(F.col("doc_id") % 7 > 0, F.sequence(F.lit(1), (F.col("doc_id") % 7).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("as ["), kind(i), ((F.col("doc_id") * i) % 5).cast("string"), F.lit("] says")))
    return F.concat_ws("\n", F.array_join(refs, ", "), F.regexp_replace("text", "(source|note|insight):", "$1 "))


@query("c18_citations", f"SELECT doc_id, unnest(range(0, len(r))) AS pos, unnest(r) AS ref FROM ({REFS_SQL})")
def _(spark, d):
    return logical(spark, d, "documents").select("doc_id", F.posexplode(T.citations(cited()))).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("ref"))


@query("c19_citation_numbers", f"SELECT doc_id, array_to_string(list_transform(range(1, len(r) + 1), lambda i: 'as [' || {FIRST_SQL.format('list_position(r, r[i])')} || '] says'), ', ') AS numbered, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS refs FROM ({REFS_SQL})")
def _(spark, d):
    done, refs = T.numbered_citations(F.col("cited"))
    return logical(spark, d, "documents").withColumn("cited", cited()).select("doc_id", F.substring_index(done, "\n", 1).alias("numbered"), F.array_join(refs, ",").alias("refs"))


@query("c22_digest_ids", with_tables("SELECT record_id, substr(sha1(CAST(equipment AS VARCHAR) || chr(0) || coalesce(mode_text, '')), 1, 8) AS scope_id FROM record"))
def _(spark, d):
    return logical(spark, d, "record").select("record_id", T.digest_id(F.col("equipment").cast("string"), F.coalesce("mode_text", F.lit(""))).alias("scope_id"))


@query("c26_highlight", "SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(the|la|der)\\b', '`\\1`', 'g')) AS text_md5 FROM documents WHERE lang = 'en'")
def _(spark, d):
    return logical(spark, d, "documents").where("lang = 'en'").select("doc_id", F.md5(T.highlight(F.col("text"), ["the", "la", "der"])).alias("text_md5"))


@query("c27_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS cut FROM documents")
def _(spark, d):
    return logical(spark, d, "documents").select("doc_id", T.ellipsis(F.col("text"), 80).alias("cut"))


@query("c28_id_list", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a,' || CAST(user_id AS VARCHAR) ELSE '' END AS ids FROM events")
def _(spark, d):
    j = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a","'), F.col("user_id").cast("string"), F.lit('"]'))).otherwise(F.lit("not json"))
    return logical(spark, d, "events").select("event_id", F.array_join(T.id_list(j), ",").alias("ids"))


@query("b1_omit_heavy", with_tables("SELECT id, title, lang, equipment_code FROM source"))
def _(spark, d):
    return logical(spark, d, "source").drop("full_text")


@query("b2_source_type", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'file' WHEN url IS NOT NULL AND page_id % 3 = 1 THEN 'link' ELSE 'text' END AS kind FROM pages")
def _(spark, d):
    p = logical(spark, d, "pages").withColumn("file_path", F.when(F.col("page_id") % 3 == 0, F.lit("x.pdf"))).withColumn("url", F.when(F.col("page_id") % 3 != 2, F.col("url")))
    return p.select("page_id", F.when(F.col("file_path").isNotNull(), "file").when(F.col("url").isNotNull(), "link").otherwise("text").alias("kind"))


@query("b3_code_filter", with_tables("SELECT id, equipment_code FROM source WHERE upper(coalesce(equipment_code, '')) = upper(trim(' eq7 '))"))
def _(spark, d):
    return logical(spark, d, "source").where(F.upper(F.coalesce("equipment_code", F.lit(""))) == F.upper(F.trim(F.lit(" eq7 ")))).select("id", "equipment_code")


@query("b5_archived_filter", with_tables("SELECT id, name FROM notebook WHERE archived"))
def _(spark, d):
    return logical(spark, d, "notebook").where("archived").select("id", "name")


@query("b7_lookup_missing", with_tables("SELECT r.id, s.id IS NOT NULL AS found FROM (SELECT DISTINCT user_id * 7 AS id FROM events) r LEFT JOIN source s ON s.id = r.id"))
def _(spark, d):
    wanted = logical(spark, d, "events").select((F.col("user_id") * 7).alias("id")).distinct()
    known = logical(spark, d, "source").select("id", F.lit(True).alias("found"))
    return wanted.join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


@query("b8_listing_sort", with_tables("SELECT id, row_number() OVER (ORDER BY lower(coalesce(title, '')), id) AS place FROM source"))
def _(spark, d):
    from kbspark.operators.graph import numbered

    return numbered(logical(spark, d, "source").select("id", F.lower(F.coalesce("title", F.lit(""))).alias("t")), [F.col("t"), F.col("id")], "place").select("id", "place")
