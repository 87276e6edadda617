"""Registered queries: corpus hygiene."""

from pyspark.sql import functions as F

from drawlake.operators import corpus
from drawlake.plans.registry import define_input, query
from drawlake.session import checkpoint

# 63-bit codes: bit i - 1 tells whether element i exceeds the median; every fifth vector gets a planted copy.
define_input(
    "signatures",
    """WITH codes AS (SELECT vec_id, aggregate(transform(sequence(1, 63), i -> CASE WHEN element_at(embedding, i + 1) > m THEN shiftleft(1L, i - 1) ELSE 0L END), 0L, (a, b) -> a | b) AS code
         FROM (SELECT vec_id, embedding, element_at(array_sort(slice(embedding, 2, 63)), 32) AS m FROM {embeddings}) AS s)
       SELECT vec_id AS id, code AS signature, 1 + vec_id % 4 / 100 AS aspect FROM codes
       UNION ALL SELECT 1000000 + vec_id, code ^ (shiftleft(1L, CAST(vec_id % 7 AS INT)) - 1), 1 + vec_id % 4 / 100 FROM codes WHERE vec_id % 5 = 0
       UNION ALL SELECT 2000000 + vec_id, code, 1 + vec_id % 4 / 100 FROM codes WHERE vec_id % 10 = 0""",
    """SELECT id, signature, aspect FROM (WITH codes AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > m THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS code
         FROM (SELECT vec_id, embedding, list_sort(embedding[2:64])[32] AS m FROM {embeddings}) AS s)
       SELECT vec_id AS id, code AS signature, 1 + vec_id % 4 / 100 AS aspect FROM codes
       UNION ALL SELECT 1000000 + vec_id, xor(code, (CAST(1 AS BIGINT) << (vec_id % 7)) - 1), 1 + vec_id % 4 / 100 FROM codes WHERE vec_id % 5 = 0
       UNION ALL SELECT 2000000 + vec_id, code, 1 + vec_id % 4 / 100 FROM codes WHERE vec_id % 10 = 0)""",
)
UNIQUE = "SELECT signature, aspect, min(id) AS id FROM {signatures} GROUP BY 1, 2"
NEAR = f"""SELECT l.id AS a, r.id AS b, CAST(bit_count(xor(l.signature, r.signature)) AS INT) AS distance FROM ({UNIQUE}) l JOIN ({UNIQUE}) r ON l.id < r.id
  AND bit_count(xor(l.signature, r.signature)) <= 4 AND greatest(l.aspect, r.aspect) / least(l.aspect, r.aspect) <= 1.03"""


@query("near_duplicate_pairs", NEAR)
def near_duplicate_pairs(t):
    return corpus.near_duplicates(t("signatures"))


COMPONENTS = f"""SELECT s.id, min(g.id) AS component FROM {{signatures}} s JOIN (SELECT id, root FROM (WITH RECURSIVE e AS (SELECT a, b FROM ({NEAR}) x UNION SELECT b, a FROM ({NEAR}) y
       UNION SELECT u.id, s.id FROM {{signatures}} s JOIN ({UNIQUE}) u USING (signature, aspect) UNION SELECT s.id, u.id FROM {{signatures}} s JOIN ({UNIQUE}) u USING (signature, aspect)),
       r AS (SELECT id, id AS root FROM {{signatures}} UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT * FROM r)) q ON q.id = s.id JOIN {{signatures}} g ON g.id = q.root GROUP BY s.id"""


@query("connected_components", COMPONENTS)
def connected_components(t):
    return corpus.duplicate_groups(t("signatures"))


@query(
    "group_split",
    f"""WITH g AS ({COMPONENTS}), sized AS (SELECT component, count(*) AS n, bool_or(id % 97 = 0) AS forced FROM g GROUP BY component),
       shares AS (SELECT n, sum(n) AS part, sum(sum(n)) OVER (ORDER BY n DESC) - sum(n) AS before, sum(sum(n)) OVER () AS total FROM sized GROUP BY n),
       cut AS (SELECT component, n, forced, (before + CAST(concat('0x', substring(sha256(concat('split:', component)), 1, 8)) AS BIGINT) / 4294967296.0 * part) / total AS place
         FROM sized JOIN shares USING (n))
       SELECT component, n, CASE WHEN forced OR place < 0.70 THEN 'train' WHEN place < 0.85 THEN 'val' ELSE 'test' END AS split FROM cut""",
)
def group_split(t):
    """Groups that hold an item the manifest forces into training stay there whole."""
    groups = checkpoint(corpus.duplicate_groups(t("signatures")))
    return corpus.split_groups(groups, train_groups=groups.where("id % 97 = 0"))


@query(
    "split_leakage",
    """SELECT 'group_id' AS leak_key, group_id AS value, count(DISTINCT split) AS splits, count(*) AS n FROM {manifest} GROUP BY group_id HAVING count(DISTINCT split) > 1
       UNION ALL SELECT 'source_sha256', source_sha256, count(DISTINCT split), count(*) FROM {manifest} GROUP BY source_sha256 HAVING count(DISTINCT split) > 1""",
)
def split_leakage(t):
    rows = t("manifest")
    return corpus.leakage(rows, "group_id").unionByName(corpus.leakage(rows, "source_sha256"))


@query(
    "exposure_join",
    """SELECT e.doc_id AS case_id, CASE WHEN m.case_id IS NULL THEN 'unknown' WHEN e.digest <> m.source_sha256 THEN 'source_hash_mismatch' WHEN m.state = 'failed' THEN 'excluded_label_in_development_split'
       WHEN m.split = 'train' THEN 'optimization_training' WHEN m.split = 'val' THEN 'checkpoint_selection' ELSE 'development_test' END AS role
       FROM (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN sha256(lang) ELSE sha256(text) END AS digest FROM {documents}) e LEFT JOIN (SELECT * FROM {manifest} WHERE case_id % 17 <> 0) m ON m.case_id = e.doc_id""",
)
def exposure_join(t):
    """Role of an evaluation case in training: by id, then only when the source hashes agree."""
    digest = F.sha2(F.when(F.col("doc_id") % 19 == 0, F.col("lang")).otherwise(F.col("text")), 256)
    cases = t("documents").select(F.col("doc_id").alias("case_id"), digest.alias("digest"))
    known = t("manifest").where("case_id % 17 <> 0").select("case_id", "split", "state", "source_sha256")
    role = (
        F.when(F.col("split").isNull(), "unknown").when(F.col("digest") != F.col("source_sha256"), "source_hash_mismatch")
        .when(F.col("state") == "failed", "excluded_label_in_development_split").when(F.col("split") == "train", "optimization_training")
        .when(F.col("split") == "val", "checkpoint_selection").otherwise("development_test")
    )
    return cases.join(known, "case_id", "left").select("case_id", role.alias("role"))


@query(
    "split_identity_check",
    """SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.case_id IS NULL THEN 'added' WHEN b.case_id IS NULL THEN 'removed' ELSE 'changed' END AS difference
       FROM (SELECT * FROM {manifest} WHERE case_id % 23 <> 0) a FULL JOIN (SELECT case_id, CASE WHEN case_id % 29 = 0 THEN 'val' ELSE split END AS split FROM {manifest} WHERE case_id % 31 <> 0) b ON a.case_id = b.case_id
       WHERE a.case_id IS NULL OR b.case_id IS NULL OR a.split <> b.split""",
)
def split_identity_check(t):
    rows = t("manifest")
    old = rows.where("case_id % 23 <> 0").select("case_id", F.col("split").alias("old"))
    new = rows.where("case_id % 31 <> 0").select("case_id", F.when(F.col("case_id") % 29 == 0, "val").otherwise(F.col("split")).alias("new"))
    difference = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, "case_id", "full_outer").select("case_id", difference.alias("difference")).where("difference is not null")


@query(
    "review_override",
    """SELECT m.case_id, CASE WHEN l.quality = 1 AND m.case_id % 6 <> 0 THEN 'local_user_review' ELSE m.label_source END AS label_source,
       coalesce(l.quality = 1 AND m.case_id % 6 <> 0, false) AS reviewed, l.quality = 1 AND m.case_id % 6 = 0 AS stale FROM {manifest} m LEFT JOIN {labels} l ON l.doc_id = m.case_id""",
)
def review_override(t):
    """A manual review replaces the frozen label only while it names the current source."""
    reviews = t("labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("asked"))
    current = F.col("case_id") % 6 != 0
    applied = F.coalesce(F.col("asked") & current, F.lit(False))
    return t("manifest").join(reviews, "case_id", "left").select(
        "case_id", F.when(applied, "local_user_review").otherwise(F.col("label_source")).alias("label_source"), applied.alias("reviewed"), (F.col("asked") & ~current).alias("stale")
    )


@query(
    "reference_match",
    """SELECT token, min_by(name, (partial, -version, name)) AS best, count(*) AS candidates FROM (SELECT doc_id % 300 AS token, doc_id % 5 = 0 AS partial, n_chars % 7 AS version,
       concat(source, '_', doc_id) AS name FROM {documents}) q GROUP BY token""",
)
def reference_match(t):
    """Best reference per drawing token: complete before partial, newest version, then name."""
    files = t("documents").select(
        (F.col("doc_id") % 300).alias("token"), (F.col("doc_id") % 5 == 0).alias("partial"), (F.col("n_chars") % 7).alias("version"),
        F.concat_ws("_", "source", F.col("doc_id")).alias("name"),
    )
    return files.groupBy("token").agg(F.min_by("name", F.struct("partial", -F.col("version"), "name")).alias("best"), F.count("*").alias("candidates"))


@query(
    "source_inventory",
    "SELECT lower(source) AS source, count(*) AS images, count(DISTINCT sha256(text)) AS contents, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM {documents} GROUP BY 1",
)
def source_inventory(t):
    rows = t("documents").select(F.lower("source").alias("source"), F.sha2("text", 256).alias("digest"))
    per = rows.groupBy("source", "digest").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("images"), F.count("*").alias("contents"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query(
    "manifest_scan",
    """SELECT case_id, concat_ws(',', CASE WHEN state = 'failed' THEN 'declared_untrainable' END, CASE WHEN n_chars < 200 THEN 'missing_label_mask' END, CASE WHEN label_source = 'de' THEN 'unsupported_label_source' END) AS reasons FROM {manifest}""",
)
def manifest_scan(t):
    reasons = F.concat_ws(
        ",", F.when(F.col("state") == "failed", "declared_untrainable"), F.when(F.col("n_chars") < 200, "missing_label_mask"), F.when(F.col("label_source") == "de", "unsupported_label_source")
    )
    return t("manifest").select("case_id", reasons.alias("reasons"))
