"""One registered query per operator over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import remainder, table


def op1_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.lm_score import lm_scores

    held = remainder(F.col("doc_id"), 5) == 1
    scored = lm_scores(table(spark, sf, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "ctx_tokens")


def op2_quality_cascade(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.quality import cascade

    docs = table(spark, sf, "documents")
    v = docs.select("doc_id", cascade(docs, measure_all=True).alias("v")).select("doc_id", "v.*")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return v.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"),
    )


def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.chat_format import conversation_digests, format_chat

    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    return conversation_digests(format_chat(given.union(own)))


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.exact_dedup import dedup

    return dedup(spark, f"{sf}/documents.parquet").drop("at")


def op10_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf, "documents"))


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.lang_id import identify, learn

    docs = table(spark, sf, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    model = learn(docs.where(~held))
    answered = docs.select("doc_id", identify(model, F.col("text"), spark).alias("a"))
    return answered.select("doc_id", held.alias("held_out"), F.col("a.language").alias("lang_pred"), "a.score", "a.accepted")


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.toxicity import CUT, learn, toxicity

    docs = table(spark, sf, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    model = learn(docs, table(spark, sf, "labels"), ~held)
    scored = docs.select("doc_id", toxicity(model, F.col("text"), spark).alias("score"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from tablewright.llm.packing import pack

    pieces = pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_piece_encoding(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from tablewright.llm.pieces import encode_texts

    encoded = encode_texts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    n = (F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", n.alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "round_trip")


def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files source/thousand/hundred/doc_id; any file with a licence line speaks for its directory."""
    from tablewright.llm.licenses import license_scan

    docs = table(spark, sf, "documents")
    step = lambda size: F.floor(F.col("doc_id") / size).cast("string")
    path = F.concat_ws("/", "source", step(10000), step(100), F.col("doc_id").cast("string"))
    found = license_scan(docs.select(path.alias("path"), "text"), is_license_file=F.col("license").isNotNull())
    doc_id = F.element_at(F.split("path", "/"), -1).cast("long")
    return found.select(doc_id.alias("doc_id"), "path", "license", "score", "origin", "origin_path", "unit")


def op11_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_phrase_mining(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.phrases import collocations

    return collocations(table(spark, sf, "documents"), least=100, within=100, top=2000)


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from tablewright.llm.merkle import merkle_manifest

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(remainder(F.col("doc_id"), 5) == 0, lowered).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle_manifest(table(spark, sf, "documents"), fields, "source", "doc_id", {"text": tampered})


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_score, op2_quality_cascade, op3_chat_format, op4_language_id, op5_packing, op6_toxicity, op7_exact_dedup,
        op8_piece_encoding, op9_license_scan, op10_near_dedup, op11_decontamination, op12_phrase_mining, op13_merkle_manifest,
    )
}

_OP2 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM cut WHERE len(words) >= 8)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS j FROM repeated) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda w: length(w) > 1 AND w = upper(w) AND w <> lower(w))) AS n_shouted
  FROM cut LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 2 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_shouted > 60 * n_words) AS kept
FROM m
"""

_OP3 = r"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\\[\]<]', '', 'g')) AS long_text,
    length(role) + length(regexp_replace(role, '[^\\\[\]<]', '', 'g')) AS long_role,
    CASE WHEN conv_id IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 END AS i,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM turns
), f AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN i = 1 AND role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END AS fits
  FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(long_text + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 8 ELSE 16 + long_role END)::BIGINT AS formatted_chars,
  coalesce(min(i) FILTER (WHERE NOT fits), CASE WHEN arg_max(role, i) <> 'assistant' THEN count(*) END)::BIGINT AS bad_turn
FROM f GROUP BY conv_id
"""

_OP7 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_OP10 = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(CASE WHEN len(words) = 0 THEN [] ELSE range(1, greatest(len(words) - 3, 2)) END) AS i FROM cut)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM cut UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT c.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id, c.doc_id = min(r.b) AS kept
FROM cut c LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.a = c.doc_id GROUP BY c.doc_id, s.n
"""



_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, m, array_to_string(words[i:i + m - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS i FROM (SELECT *, least(len(words), 10) AS m FROM b WHERE len(words) > 0))
), dw AS (
  SELECT rid, i, m, array_to_string(words[i:i + m - 1], ' ') AS w
  FROM (SELECT rid, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM iw) WHERE len(words) >= m)
), found AS (SELECT rid, i, m, item_id FROM dw JOIN iw USING (m, w)),
hit AS (SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT rid, i, unnest(range(0, m)) AS j FROM (SELECT DISTINCT rid, i, m FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  coalesce(items.h, sha256('')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM cut GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM cut, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(words) >= k)
), f AS (SELECT lang, phrase, k, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
parts AS (
  SELECT lang, phrase, n AS a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k >= 2)
), scored AS (
  SELECT p.*, x.n AS l, y.n AS r, t.n, ((1000::HUGEINT * a * t.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first JOIN f y ON y.lang = p.lang AND y.phrase = p.rest JOIN total t ON t.lang = p.lang
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
free AS (
  SELECT * FROM worst w WHERE NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = w.lang AND f.n >= w.a AND f.phrase <> w.phrase AND contains(' ' || f.phrase || ' ', ' ' || w.phrase || ' '))
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score FROM free
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000
"""


def _op13(levels: int = 6) -> str:
    """Trees of up to 16^levels leaves, level by level; the crc is worked out bit by bit."""
    # crc32 (IEEE, reflected): polynomial 0xEDB88320, start and final complement 0xFFFFFFFF
    shift = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {shift})"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda a, b: {byte}), 4294967295)"
    part = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')"
    row = lambda text: "sha256(" + " || ".join([*[part(c) for c in ("doc_id", "source", "lang", "n_chars")], text]) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"hashed AS (SELECT doc_id, coalesce('v' || source, '-') AS tree, {row(part('text'))} AS leaf, {row(part('other'))} AS changed "
        f"FROM (SELECT *, CASE WHEN coalesce({crc}, 0) % 5 = 0 THEN {lowered} ELSE text END AS other FROM documents))",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed)",
        "d0 AS (SELECT tree, pos AS i, leaf AS h FROM leaves)",
    ]

    def climb(x: str) -> None:
        for k in range(levels):
            ctes.append(
                f"{x}r{k} AS (SELECT tree, i // 16 AS g, list(h ORDER BY i) AS run, any_value(n) AS n "
                f"FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {x}{k}) GROUP BY tree, i // 16)"
            )
            ctes.append(f"{x}{k + 1} AS (SELECT tree, g AS i, CASE WHEN n = 1 THEN run[1] ELSE sha256(list_aggregate(run, 'string_agg', '')) END AS h FROM {x}r{k})")

    def walk(x: str, base: str) -> None:
        """Proof and fold of each row of ``base`` (tree, pos, proof, folded) up the tree ``x``."""
        for k in range(levels):
            i = f"((w.pos // {16**k}) % 16)"
            before = f"coalesce(array_to_string(r.run[1:{i}], ''), '')"
            after = f"coalesce(array_to_string(r.run[{i} + 2:], ''), '')"
            ctes.append(
                f"{base}{k + 1} AS (SELECT w.* EXCLUDE (proof, folded), CASE WHEN n = 1 THEN proof ELSE proof || {before} || {after} END AS proof, "
                f"CASE WHEN n = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded "
                f"FROM {base}{k} w JOIN {x}r{k} r ON r.tree = w.tree AND r.g = w.pos // {16 ** (k + 1)})"
            )

    climb("d")
    ctes.append(f"c0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, tree AS name FROM d{levels})")
    climb("c")
    ctes.append("p0 AS (SELECT tree, pos, doc_id, leaf, '' AS proof, changed AS folded FROM leaves)")
    walk("d", "p")
    ctes.append(
        f"q0 AS (SELECT p.doc_id, p.leaf, p.proof, p.folded, c0.h AS subroot, '' AS tree, c0.i AS pos FROM p{levels} p JOIN c0 ON c0.name = p.tree)"
    )
    walk("c", "q")
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, "
        f"folded = r.h AS verified FROM q{levels} JOIN c{levels} r ON true"
    )


ORACLES = {"op11_decontamination": _OP11, "op12_phrase_mining": _OP12, "op13_merkle_manifest": _op13(), "op2_quality_cascade": _OP2, "op3_chat_format": _OP3, "op7_exact_dedup": _OP7, "op10_near_dedup": _OP10}
