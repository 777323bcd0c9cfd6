"""One query per numbered operator over its whole table, and SQL where SQL can express it."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import bpe, chat, merkle, runs, warc
from windrow.llm.common import on_workers, read_table
from windrow.llm.exact_dedup import dedup_groups
from windrow.llm.fingerprints import fingerprint_chain
from windrow.llm.mixing import mix_plan
from windrow.llm.near_dedup import near_groups
from windrow.llm.packing import pack_documents
from windrow.llm.secret_scan import secret_findings
from windrow.llm.token_files import encode_and_read
from windrow.llm.toxicity import toxicity

#: Tokenizer, and the id that ends a document.
BYTE_BPE = (public_tokenizers.path("byte_bpe_50k.json"), 0)
WORD_BPE = (public_tokenizers.path("word_bpe_49k.json"), 1)
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(read_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"), words=4)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_chain(read_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(read_table(spark, sf_dir, "documents"), *BYTE_BPE)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finding itself as a digest: results should not spread secrets."""
    found = secret_findings(read_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256")
    return found.select("doc_id", "ordinal", "start", F.length("secret").alias("length"), digest, "label", "score", "is_secret")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), *WORD_BPE)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op10_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.write_and_read(rows.unionByName(extra))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering adds 1 to n_chars where 7 divides the crc32 of the doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(tampered, merkle.leaf_digest({"n_chars": F.col("n_chars") + 1}))
    found = merkle.manifest(docs, changed=changed, digests=True)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(read_table(spark, sf_dir, "documents"), runs.repeated)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_token_files": op5_token_files,
    "op6_mixing": op6_mixing,
    "op7_secret_scan": op7_secret_scan,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_chat_trees": op10_chat_trees,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}
QUERIES = {name: on_workers(query) for name, query in QUERIES.items()}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: 40 bits (ten hex digits) of a digest make eight characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(digest, {10 * g + 1}, 10))::BIGINT >> {35 - 5 * k}) & 31) + 1)::BIGINT, 1)"
    for g in range(4)
    for k in range(8)
)

#: CRC-32 of the decimal digits of doc_id, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::BIGINT)))"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR)::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


SQL = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
                   CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS now
            FROM documents
        ),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY lang) AS cnt,
                   dense_rank() OVER (ORDER BY encode(coalesce('=' || lang, ''))) AS tree
            FROM leaves
        ),
        nodes AS (
            SELECT tree, 0 AS lvl, pos, cnt, leaf AS h FROM placed
            UNION ALL
            SELECT tree, lvl + 1, pos // 2, (cnt + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
            FROM nodes WHERE cnt > 1 GROUP BY tree, lvl, pos // 2, cnt
        ),
        subroots AS (SELECT tree, lvl AS height, h AS subroot FROM nodes WHERE cnt = 1),
        tops AS (
            SELECT 0 AS lvl, tree - 1 AS pos, (SELECT count(*) FROM subroots) AS cnt, subroot AS h FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 2, (cnt + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
            FROM tops WHERE cnt > 1 GROUP BY lvl, pos // 2, cnt
        ),
        steps AS (
            SELECT p.tree, p.pos AS leaf_pos, s.lvl, s.h, s.pos > p.pos >> s.lvl AS is_right
            FROM placed p JOIN nodes s ON s.tree = p.tree AND s.cnt > 1 AND s.pos = xor(p.pos >> s.lvl, 1::BIGINT)
            UNION ALL
            SELECT p.tree, p.pos, 1000 + s.lvl, s.h, s.pos > (p.tree - 1) >> s.lvl
            FROM placed p JOIN tops s ON s.cnt > 1 AND s.pos = xor((p.tree - 1) >> s.lvl, 1::BIGINT)
        ),
        -- a node without a sibling is hashed alone
        climbed AS (
            SELECT p.tree, p.pos AS leaf_pos, n.lvl, coalesce(s.h, '') AS h, coalesce(s.is_right, true) AS is_right
            FROM placed p JOIN (SELECT DISTINCT tree, lvl FROM nodes WHERE cnt > 1) n ON n.tree = p.tree
            LEFT JOIN steps s ON s.tree = p.tree AND s.leaf_pos = p.pos AND s.lvl = n.lvl
            UNION ALL
            SELECT p.tree, p.pos, 1000 + n.lvl, coalesce(s.h, ''), coalesce(s.is_right, true)
            FROM placed p CROSS JOIN (SELECT DISTINCT lvl FROM tops WHERE cnt > 1) n
            LEFT JOIN steps s ON s.tree = p.tree AND s.leaf_pos = p.pos AND s.lvl = 1000 + n.lvl
        ),
        proofs AS (
            SELECT tree, leaf_pos, sha256(string_agg(h, '' ORDER BY lvl)) AS proof_sha256,
                   list(struct_pack(h := h, is_right := is_right) ORDER BY lvl) AS path
            FROM climbed GROUP BY tree, leaf_pos
        ),
        folded AS (
            SELECT p.*, coalesce(f.proof_sha256, sha256('')) AS proof_sha256,
                   list_reduce(list_prepend(struct_pack(h := p.now, is_right := true), coalesce(f.path, [])),
                               lambda a, s: struct_pack(h := sha256(CASE WHEN s.is_right THEN a.h || s.h ELSE s.h || a.h END), is_right := true)).h AS folded_root
            FROM placed p LEFT JOIN proofs f ON f.tree = p.tree AND f.leaf_pos = p.pos
        )
        SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE cnt = 1) AS root, proof_sha256, folded_root,
               folded_root = (SELECT h FROM tops WHERE cnt = 1) AS verified
        FROM folded JOIN subroots USING (tree)
    """,
    "op2_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op9_warc": f"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages
        )
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
        FROM p WINDOW g AS (PARTITION BY digest)
    """,
    "op6_mixing": f"""
        WITH d AS (SELECT doc_id, source, {_WORDS} AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (
            SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
                   [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight
            FROM s
        ),
        l AS (
            SELECT *, cap / weight AS ratio,
                   (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM w
        ),
        t AS (
            SELECT source, source_size,
                   least(cap, (SELECT level FROM l WHERE level * weight <= cap ORDER BY ratio, source NULLS LAST LIMIT 1)
                         * weight) AS target
            FROM l
        ),
        r AS (
            SELECT d.doc_id, d.size, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1 END AS rate,
                   ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM r
    """,
}
