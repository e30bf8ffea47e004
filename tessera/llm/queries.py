"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import ensure_importable, read

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import pii_digest

    return pii_digest(read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dedup import near_classes

    return near_classes(read(spark, sf_dir, "documents"), width=3, percent=85)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import dedup_decisions

    return dedup_decisions(read(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity_scores

    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard

    return shard(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import judge_urls

    return judge_urls(read(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_io import token_files

    return token_files(read(spark, sf_dir, "documents"), BYTE_BPE)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import word_bpe

    return word_bpe(read(spark, sf_dir, "documents"), WORD_BPE)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), BYTE_BPE)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.best_fit import best_fit

    return best_fit(read(spark, sf_dir, "documents"), BYTE_BPE)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.conversations import damaged, repair_digest

    rows = read(spark, sf_dir, "conversations")
    return repair_digest(damaged(rows), rows)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import spelling_groups

    return spelling_groups(read(spark, sf_dir, "documents"))


_QUERIES = [op1_pii, op2_near_dedup, op3_exact_dedup, op4_neighbours, op5_toxicity, op6_sharding, op7_url_filter, op8_token_files, op9_bpe, op10_packing, op11_best_fit, op12_conversations, op13_spelling]


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_importable(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _ready(q) for q in _QUERIES}


_SPACE = "[\\x20\\x09-\\x0D]+"


def _crc32(bytes_: str) -> str:
    """SQL of the crc32 of a list of byte values."""
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: {step}), 4294967295)"


def _utf8(text: str) -> str:
    """SQL of the byte values of a text in UTF-8."""
    return f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"


_CODES = "CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END"
_LAST = r"right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1)"


def _more(way: str, cost: str, letter: str) -> str:
    return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}'}}"


def _least(*ways: str) -> str:
    """The least (cost, audit) of the ways that exist."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))[1]"


def _then(state: str, *before: tuple[str, str]) -> str:
    """Ways into ``state``: deleting the turn there, or keeping or changing it from each state before that has the right initial."""
    ways = [_more(state, "2", "D")]
    for source, initial in before:
        ways.append(f"CASE WHEN NOT dead AND i = '{initial}' THEN {_more(source, 'late', 'K')} END")
        if initial != "s":
            ways.append(f"CASE WHEN NOT dead THEN {_more(source, 'late + 1', 'R')} END")
    return _least(*ways)


_SQL = {
    "op2_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op3_exact_dedup": f"""SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents) WINDOW g AS (PARTITION BY text_sha256)""",
    # the cheapest way into each state, turn by turn (n nothing so far, s, u, a); i* are the states with insertions before the turn
    "op12_conversations": f"""WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_utf8("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS d FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS again FROM h WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, again) AS r FROM m),
f AS (SELECT *, {_CODES} AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again_said, {_LAST} NOT IN ('.', '!', '?') AS open FROM o),
k AS (SELECT conv_id, r, role, text, turn, i, blank, again_said AND NOT blank AS duplicate, open AND NOT blank AND NOT again_said AS truncated, blank OR again_said AS dead, CASE WHEN open THEN 5 ELSE 0 END AS late FROM f),
w AS (SELECT conv_id, 0::BIGINT AS r, {{'c': 0::BIGINT, 'a': ''}} AS n, NULL::STRUCT(c BIGINT, a VARCHAR) AS s, NULL::STRUCT(c BIGINT, a VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR) AS a FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, r, {_then("n")}, {_then("s", ("n", "s"))}, {_then("iu", ("n", "u"), ("s", "u"), ("ia", "u"))}, {_then("ia", ("iu", "a"))}
FROM (SELECT w.conv_id, k.r, k.i, k.dead, k.late::BIGINT AS late, n, s, {_least("u", _more("n", "5", "I"), _more("s", "5", "I"), _more("a", "5", "I"))} AS iu, {_least("a", _more("n", "10", "II"), _more("s", "10", "II"), _more("u", "5", "I"))} AS ia
FROM w JOIN k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.r = w.r + 1)),
z AS (SELECT conv_id, {_least("n", "a", _more("s", "10", "II"), _more("u", "5", "I"))} AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY r DESC) = 1),
l AS (SELECT conv_id, best.c AS cost, best.a AS audit, unnest(range(1, len(best.a) + 1)) AS p FROM z),
e AS (SELECT conv_id, p, substr(audit, p, 1) AS letter, p - len(replace(substr(audit, 1, p), 'I', '')) AS inserts, len(replace(substr(audit, 1, p), 'D', '')) - 1 AS at, len(replace(audit, 'D', '')) % 2 AS odd FROM l),
t AS (SELECT e.conv_id, string_agg(CASE WHEN letter = 'K' THEN k.role WHEN (e.at - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE k.text END, chr(10) ORDER BY p) AS said
FROM e LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM e.conv_id AND k.r = p - inserts AND letter <> 'I' WHERE letter <> 'D' GROUP BY e.conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY r) || i AS pair FROM k) GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM z LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id""",
    "op13_spelling": f"""WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, {_crc32(_utf8("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM r WHERE length(run) >= 7),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, count(*) AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
x AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest),
b AS (SELECT word, count(*) AS n_near, max(n) AS near_n, arg_min(near, (-n, near)) AS near FROM x GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
c AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) c ON c.word = f.word""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of those whose result is fixed by their contract; the others learn, tokenise, search or balance."""
    return dict(_SQL)
