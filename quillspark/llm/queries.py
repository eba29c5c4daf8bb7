"""The fixed-contract queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import bpe, chat, decontam, exact_dedup, fill_middle, html_extract, language_id, merkle, mixing, pii, quality, simhash, token_count

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = merkle.digest_of(*(merkle.without_line_ends(docs) if c == "text" else F.col(c) for c in merkle.FIELDS))
    return merkle.verified(merkle.proofs(merkle.leaves(docs, extra={"changed": changed})), "changed")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored()).alias("restored_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Query]:
    every = (
        op1_language_id, op2_chat_rotation, op3_pii, op4_mixing, op5_quality, op6_simhash, op7_html_extraction, op8_exact_dedup, op9_token_counts, op10_decontamination,
        op11_merkle_manifest, op12_fill_middle, op13_bpe,
    )
    return {f.__name__: f for f in every}


OP2_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text FROM conversations),
said AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // 512 AS part FROM given),
people AS (SELECT DISTINCT conv_id AS c, role AS participant FROM said WHERE role <> 'system'),
shown AS (SELECT *, replace(replace(regexp_replace(role, '\s+', ' ', 'g'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS name FROM said),
met AS (
  SELECT s.*, p.participant, s.role = p.participant AS own,
         CASE WHEN s.role = p.participant THEN '<|im_start|>assistant' || chr(10) WHEN s.role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || s.name || chr(10) END AS head
  FROM shown s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.c),
placed AS (
  SELECT *, row_number() OVER turns AS nth, sum(length(head) + length(text) + 11) OVER turns - length(text) - 11 AS begin_at
  FROM met WINDOW turns AS (PARTITION BY conv_id, participant, part ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY nth) AS text,
       coalesce(string_agg(begin_at || ':' || (begin_at + length(text)), ',' ORDER BY nth) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, participant, part
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""




def _tree(name: str, leaves: str) -> str:
    """Vertices of trees over ``leaves`` (g, pos, d) by level, and what stands before and behind each vertex in its run."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, pos, d, count(*) OVER (PARTITION BY g) AS n FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 3, n),
{name}_near AS (
  SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS behind
  FROM {name} a JOIN {name} b ON a.g = b.g AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL)"""


def _fold(name: str, tree: str, start: str) -> str:
    """Digests of ``start`` (k, g, pos, own, proof) carried to their tree's root."""
    return f"""{name} AS (
  SELECT k, g, 0 AS lvl, pos, own, proof FROM {start}
  UNION ALL
  SELECT k, f.g, f.lvl + 1, f.pos // 3, sha256(before || own || behind), proof || before || behind FROM {name} f JOIN {tree}_near s ON s.g = f.g AND s.lvl = f.lvl AND s.pos = f.pos)"""


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: CRC-32 bit by bit; its last inversion makes an odd remainder even.
_EVEN_CRC = """list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT) % 2 = 1"""
OP11_SQL = f"""WITH RECURSIVE rows AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, sha256({_HEAD} || {_FIELD.format("text")}) AS d,
         sha256({_HEAD} || {_FIELD.format(f"CASE WHEN {_EVEN_CRC} THEN replace(text, chr(10), '') ELSE text END")}) AS changed FROM documents),
{_tree("low", "rows")},
roots AS (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, g AS below, d FROM low WHERE n = 1),
{_tree("high", "roots")},
given AS (SELECT doc_id AS k, g, pos, changed AS own, '' AS proof FROM rows),
{_fold("rise", "low", "given")},
middle AS (SELECT k, 0 AS g, r.pos, own, proof FROM rise f JOIN roots r ON r.below = f.g JOIN low v ON v.g = f.g AND v.lvl = f.lvl AND v.n = 1),
{_fold("finish", "high", "middle")},
done AS (SELECT k, own, proof, d AS root FROM finish f JOIN high v ON v.g = f.g AND v.lvl = f.lvl AND v.n = 1)
SELECT doc_id, rows.d AS leaf, roots.d AS subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified FROM rows JOIN done ON k = doc_id JOIN roots ON below = rows.g
"""
OP12_SQL = """WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('1:' || doc_id), k, 8))::BIGINT) AS h FROM documents),
ranked AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
pieces AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM pieces
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_rotation": OP2_SQL, "op8_exact_dedup": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_fill_middle": OP12_SQL}
