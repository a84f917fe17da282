"""Registered queries of the text operators, with check SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweft.llm import chat, decontaminate, dialogue, langid, lexical, licences, mixing, neardup, quality, tokens, topk, toxicity, urls
from chainweft.llm.text import batches_of, held_out, table
from chainweft.session import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

#: Shingle sets of a table (id, text): A-Z in lower case, words between ASCII white space.
_WORDS = r"""SELECT {id} AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table}"""
_SHINGLES = """SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM {words}"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return register


@query("op1_noisy_channel_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    restored = toxicity.restoration(documents)
    patterns, base = toxicity.train(documents, table(spark, folder, "labels"), restored)
    found = toxicity.scored(documents, restored, patterns, base, "score").select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
    with batches_of(spark, 1000):
        return materialise(found, "toxicity")


@query(
    "op2_minhash_multi_index",
    f"""WITH RECURSIVE words AS ({_WORDS.format(id='doc_id', table='documents')}),
    sh AS ({_SHINGLES.format(words='words')}),
    n AS (SELECT d.doc_id AS id, count(s) AS n FROM documents d LEFT JOIN sh ON sh.id = d.doc_id GROUP BY 1),
    both_in AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
    links AS (SELECT a, b FROM both_in JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    reach AS (SELECT id, id AS to_id FROM n UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.to_id)
    SELECT r.id AS doc_id, any_value(n.n) AS n_shingles, min(to_id) AS component_id, r.id = min(to_id) AS kept
    FROM reach r JOIN n USING (id) GROUP BY r.id""",
)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), percent=85)


@query("op3_ppm_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    trees = langid.train(documents)
    return langid.identified(documents, trees, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@query("op4_licence_inheritance")
def licences_of(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scanned_documents(table(spark, folder, "documents"))


@query("op6_url_association_rules")
def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"))


@query("op7_quality_ftrl")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    weights = quality.train(documents, table(spark, folder, "labels"))
    return quality.scored(documents, weights, "score").select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query(
    "op8_benchmark_containment",
    f"""WITH dw AS ({_WORDS.format(id='doc_id', table='documents')}), ds AS ({_SHINGLES.format(words='dw')}),
    iw AS ({_WORDS.format(id='item_id', table='benchmark')}), ish AS ({_SHINGLES.format(words='iw')}),
    sets AS (SELECT id, list_sort(list(s)) AS own, count(*) AS n FROM ish WHERE id IS NOT NULL GROUP BY id),
    items AS (SELECT min(id) AS id, own, min(n) AS n FROM sets GROUP BY own),
    flat AS (SELECT id, n, unnest(own) AS s FROM items)
    SELECT ds.id AS doc_id, flat.id AS item_id, any_value(flat.n) AS n_item, count(*) AS n_found, count(*) / any_value(flat.n) AS containment
    FROM ds JOIN flat USING (s) GROUP BY ds.id, flat.id HAVING count(*) >= 0.8 * any_value(flat.n)""",
)
def contaminations(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("ident")


@query("op9_entropy_balancing")
def mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


@query("op10_token_ids")
def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.digests(tokens.written(table(spark, folder, "documents")))


_BIT = "(coalesce({v}[{i}] > 0 AND NOT isnan({v}[{i}]), false))"


@query(
    "op5_multi_index_topk",
    f"""WITH v AS (SELECT vec_id AS id, list_transform(range(1, 65), lambda i: {_BIT.format(v='embedding', i='i')}) AS c FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    d AS (SELECT a.id AS query_id, b.id AS neighbour_id,
        list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.c[i] <> b.c[i] THEN 1 ELSE 0 END))::INT AS distance
        FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS rank, neighbour_id, distance
    FROM d QUALIFY rank <= 10""",
)
def nearest_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=10)


#: crc32 of an ASCII string, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)),
    lambda v, b: list_reduce(list_concat([xor(v, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query(
    "op11_conversation_repair",
    rf"""WITH RECURSIVE coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
        {_CRC.format(s="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
    damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS r,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x,
        unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS i FROM damaged),
    judged AS (SELECT conv_id, turn, r, x, i, left(r, 1) AS c, lag(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c0,
        CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 'blank'
             WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM placed),
    faults AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (c0 || c NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
    ins(before, mid, pre, cost, lines) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (0, 2, 'I', 2, ['user:']), (0, 3, 'II', 4, ['user:', 'assistant:']),
        (1, 1, '', 0, []), (1, 2, 'I', 2, ['user:']), (1, 3, 'II', 4, ['user:', 'assistant:']), (2, 2, '', 0, []), (2, 3, 'I', 2, ['assistant:']),
        (2, 2, 'II', 4, ['assistant:', 'user:']), (3, 3, '', 0, []), (3, 2, 'I', 2, ['user:']), (3, 3, 'II', 4, ['user:', 'assistant:'])),
    acts(mid, letter, need, after, cost, named) AS (VALUES (0, 'D', NULL, 0, 3, NULL), (1, 'D', NULL, 1, 3, NULL), (2, 'D', NULL, 2, 3, NULL), (3, 'D', NULL, 3, 3, NULL),
        (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL),
        (0, 'R', NULL, 2, 2, 'user'), (1, 'R', NULL, 2, 2, 'user'), (3, 'R', NULL, 2, 2, 'user'), (2, 'R', NULL, 3, 2, 'assistant')),
    moves AS (SELECT ins.before, pre || letter AS edit, need, after, letter, named, ins.cost + acts.cost AS cost, lines FROM ins JOIN acts USING (mid)),
    paths AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM faults
        UNION ALL SELECT * FROM (SELECT p.conv_id, p.i + 1, m.after, p.cost + m.cost + CASE WHEN m.letter <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
            p.audit || m.edit AS audit, list_concat(list_concat(p.lines, m.lines), CASE WHEN m.letter = 'D' THEN [] ELSE [coalesce(m.named, j.r) || ':' || j.x] END)
            FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1 JOIN moves m ON m.before = p.state
            AND (m.need IS NULL OR m.need = j.c) AND (m.letter = 'D' OR j.fault IS NULL OR j.fault = 'truncated')
            QUALIFY row_number() OVER (PARTITION BY p.conv_id, m.after ORDER BY p.cost + m.cost + CASE WHEN m.letter <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END, p.audit || m.edit) = 1)),
    ended AS (SELECT p.conv_id, p.cost + i.cost AS cost, p.audit || i.pre AS audit, array_to_string(list_concat(p.lines, i.lines), chr(10)) AS out
        FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.i JOIN ins i ON i.before = p.state AND (i.mid = 3 OR (i.mid = 0 AND i.pre = ''))
        QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + i.cost, p.audit || i.pre) = 1)
    SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
        coalesce(f.illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(e.out, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""",
)
def repairs(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.reports(dialogue.damaged(table(spark, folder, "conversations")), times="times")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(
    "op12_shared_term_search",
    rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS w FROM documents),
    sizes AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0), totals AS (SELECT count(*) AS docs, sum(n) AS words FROM sizes),
    tf AS (SELECT r, s, count(*) AS tf FROM (SELECT r, unnest(w) AS s FROM d) GROUP BY r, s),
    wt AS (SELECT s, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT s, count(*) AS df FROM tf GROUP BY s), totals),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS s FROM benchmark),
    scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * docs) // words)))))::BIGINT AS score
        FROM asked JOIN wt USING (s) JOIN tf USING (s) JOIN sizes USING (r), totals GROUP BY item_id, r, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10""",
)
def lexical_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


_OK = "</s>[INST] ok [/INST]"
_CONTROL = r"<\\*(?:<SYS>>|</SYS>>|s>|/s>|role>|text>|/text>|part>)|\[\\*(?:INST\]|/INST\])"


@query(
    "op13_chat_format",
    rf"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{_OK}'), (-7, 1, 'assistant', '{_OK}')),
    placed AS (SELECT *, row_number() OVER w AS i, lag(r) OVER w AS r0, lead(r) OVER w AS r1 FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x)),
    sized AS (SELECT *, length(x) + len(regexp_extract_all(x, '{_CONTROL}'))
        + CASE WHEN r0 = r THEN 6 ELSE CASE r WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3 ELSE 12 + length(r) + len(regexp_extract_all(r, '{_CONTROL}')) END END
        + CASE WHEN r1 = r THEN 0 ELSE CASE r WHEN 'system' THEN 8 WHEN 'user' THEN 7 WHEN 'assistant' THEN 4 ELSE 7 END END AS chars FROM placed)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
        coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (r = 'assistant'), '')) AS loss_sha256,
        sum(chars)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id""",
)
def chats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_OK).alias("text"))
    return chat.read_back(materialise(chat.formatted(rows.unionByName(odd)), "chats"))
