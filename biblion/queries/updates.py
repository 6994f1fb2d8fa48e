"""Updates of the library: articles, chunks, mentions, edges, syntheses, caches, prompts, workspaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from biblion.functions import text as T
from biblion.operators import graph as G
from biblion.operators import ingest as I
from biblion.operators import library as L
from biblion.operators.resolution import register_mentions
from biblion.queries import kb
from biblion.session import table

query = kb.Registry()
QUERIES, ORACLE = query.queries, query.oracle
_DOI = r"trim(regexp_replace(regexp_replace(lower(trim({0})), '^(?:https?://|dx\.doi\.org/|www\.doi\.org/|doi\.org/|doi:|\s)+', ''), '[.,]+$', ''))"
_FORM = "regexp_replace(replace(replace(replace(replace(replace(lower({0}), 'large language model', 'llm'), 'large-language-model', 'llm'), 'chat bot', 'chatbot'), 'chat-bot', 'chatbot'), 'self-management', 'self management'), '[^a-z0-9]', ' ', 'g')"
_TITLE = f"array_to_string(list_filter(string_split_regex({_FORM}, ' +'), lambda w: w <> '' AND w <> 'preprint'), ' ')"
_CAND = "(SELECT cand_uid AS uid, min(title) AS title, min(doi) AS doi, min(journal) AS journal, min(summary) AS summary FROM article_candidate GROUP BY 1)"


def candidates(spark, d):
    return table(spark, d, "article_candidate").groupBy(F.col("cand_uid").alias("uid")).agg(*[F.min(c).alias(c) for c in ("title", "doi", "journal", "summary")])


_SAVE = f"""WITH a AS (SELECT uid, title, doi, journal, nullif({_DOI.format('doi')}, '') AS dk, nullif({_TITLE.format('title')}, '') AS tk FROM {{art}}),
c AS (SELECT uid, title, doi, journal, length(uid) % 2 = 0 AS evaluated, nullif({_DOI.format('doi')}, '') AS dk, nullif({_TITLE.format('title')}, '') AS tk FROM {_CAND}),
bd AS (SELECT dk, min(uid) AS u FROM a WHERE dk IS NOT NULL GROUP BY 1), bt AS (SELECT tk, min(uid) AS u FROM a WHERE tk IS NOT NULL GROUP BY 1),
t AS (SELECT c.*, coalesce(bd.u, bt.u) AS target FROM c LEFT JOIN bd ON bd.dk = c.dk LEFT JOIN bt ON bt.tk = c.tk),
best AS (SELECT target, max(uid) AS uid FROM t WHERE target IS NOT NULL AND evaluated GROUP BY 1)"""


@query(_SAVE + " SELECT a.uid, CASE WHEN b.uid IS NULL THEN 'kept' ELSE 'updated' END AS change, coalesce(nullif(trim(t.title), ''), a.title) AS title, coalesce(nullif(trim(t.journal), ''), a.journal) AS journal FROM a LEFT JOIN best b ON b.target = a.uid LEFT JOIN t ON t.uid = b.uid UNION ALL SELECT uid, 'inserted', nullif(trim(title), ''), nullif(trim(journal), '') FROM t WHERE target IS NULL")
def mut_article_save(spark, d):
    """Candidates saved: one that repeats an article by DOI or title enriches it if it is evaluated, else is skipped; the others are new."""
    new = candidates(spark, d).withColumn("evaluated", F.length("uid") % 2 == 0)
    return L.save_articles(kb.articles(spark, d), new, ["title", "journal"]).select("uid", "change", "title", "journal")


_UPD = "(SELECT uid, min(full_text) AS full_text, min(source_type) AS source_type FROM extracted_text GROUP BY uid)"


@query(f"""WITH n AS (SELECT uid, CASE WHEN length(uid) % 5 = 0 THEN 'short abstract' ELSE full_text END AS full_text, CASE WHEN length(uid) % 5 = 0 THEN 'abstract_only' ELSE source_type END AS content_type FROM {_UPD})
SELECT a.uid, CASE WHEN n.full_text IS NOT NULL AND trim(n.full_text) <> '' AND (n.content_type <> 'abstract_only' OR nullif(trim(a.abstract_text), '') IS NULL) THEN n.full_text ELSE a.abstract_text END AS full_text,
CASE WHEN n.full_text IS NOT NULL AND trim(n.full_text) <> '' AND (n.content_type <> 'abstract_only' OR nullif(trim(a.abstract_text), '') IS NULL) THEN n.content_type ELSE a.content_type END AS content_type,
CASE WHEN n.full_text IS NOT NULL AND n.content_type <> 'abstract_only' THEN NULL ELSE 'no text yet' END AS error, n.uid IS NOT NULL AS marked FROM {{art}} a LEFT JOIN n ON n.uid = a.uid""")
def mut_article_update(spark, d):
    """Fetched text replaces, an abstract only fills a blank; an error is cleared by success."""
    x = table(spark, d, "extracted_text").groupBy("uid").agg(F.min("full_text").alias("full_text"), F.min("source_type").alias("content_type"))
    short = F.length("uid") % 5 == 0
    new = x.select("uid", F.when(short, "short abstract").otherwise(F.col("full_text")).alias("full_text"), F.when(short, "abstract_only").otherwise(F.col("content_type")).alias("content_type"), F.lit(True).alias("marked"))
    old = kb.articles(spark, d).select("uid", F.col("abstract_text").alias("full_text"), "content_type", F.lit("no text yet").alias("error"))
    return L.update_text(old, new).select("uid", "full_text", "content_type", "error", "marked")


@query("SELECT uid, coalesce(nullif(trim(abstract_text), ''), byline_summary) AS full_text, coalesce(content_type, 'abstract_only') AS content_type, CASE WHEN content_type IN ('pdf', 'pdf_stored') AND nullif(trim(abstract_text), '') IS NULL THEN 'needs_reextract' ELSE 'extracted' END AS status FROM {art}")
def mut_default_content(spark, d):
    """What is stored where nothing was fetched: the abstract, its type, and whether a stored PDF is to be read again."""
    return L.default_content(kb.articles(spark, d), "abstract_text", "byline_summary", "content_type").select("uid", "full_text", "content_type", "status")


@query("SELECT id, article_uid, chunk_index, content FROM {chunk} WHERE article_uid NOT IN (SELECT uid FROM extracted_text) UNION ALL SELECT -row_number() OVER (ORDER BY uid), uid, 0, left(full_text, 100) FROM (SELECT uid, min(full_text) AS full_text FROM extracted_text GROUP BY uid) WHERE uid IN (SELECT article_uid FROM {chunk})")
def mut_chunks_replace(spark, d):
    """All chunks of the articles that were read again give way to the new ones."""
    c = kb.chunks(spark, d).select("id", "article_uid", "chunk_index", "content")
    x = table(spark, d, "extracted_text").groupBy("uid").agg(F.min("full_text").alias("full_text")).join(c.select(F.col("article_uid").alias("uid")).distinct(), "uid", "left_semi")
    new = L.with_new_ids(x.select(F.col("uid").alias("article_uid"), F.lit(0).alias("chunk_index"), F.left("full_text", F.lit(100)).alias("content")), "id", "article_uid", -1)
    gone = c.join(table(spark, d, "extracted_text").select(F.col("uid").alias("article_uid")).distinct(), "article_uid", "left_anti")
    return I.replace_rows(gone, new, "article_uid").select("id", "article_uid", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query("SELECT article_uid, entity_id, chunk_index, min(mention_id) AS mention_id FROM {ment} WHERE k < 2 GROUP BY 1, 2, 3 UNION ALL SELECT article_uid, entity_id, chunk_index, min(mention_id) FROM {ment} n WHERE k = 2 AND NOT EXISTS (SELECT 1 FROM {ment} o WHERE o.k < 2 AND o.article_uid = n.article_uid AND o.entity_id = n.entity_id AND o.chunk_index = n.chunk_index) GROUP BY 1, 2, 3")
def mut_mentions_ignore(spark, d):
    """New mentions (of the third entity of each chunk) are added unless article, entity and place are known."""
    keys = ["article_uid", "entity_id", "chunk_index"]
    first = lambda cond: kb.mentions(spark, d).where(cond).groupBy(*keys).agg(F.min("mention_id").alias("mention_id"))
    return I.insert_missing(first("k < 2"), first("k = 2"), keys).select(*keys, "mention_id")


@query("SELECT src, tgt, rel_type, sum(w)::DOUBLE AS weight FROM (SELECT src, tgt, rel_type, weight AS w FROM {edge} UNION ALL SELECT src, tgt, rel_type, 1 FROM {canon} WHERE seq % 3 = 0) GROUP BY ALL")
def mut_edge_upsert(spark, d):
    """Relations seen again raise the weight of their edge, new ones make one."""
    new = G.canonical_relations(kb.observations(spark, d).where("seq % 3 = 0"))
    return L.upsert_edges(kb.edges(spark, d), new)


@query("SELECT name, model, article_uid, id FROM (SELECT prompt_name AS name, model, article_uid, id, row_number() OVER (PARTITION BY prompt_name, model, article_uid ORDER BY id DESC) AS r FROM (SELECT DISTINCT id, prompt_name, model, article_uid FROM prompt_traces)) WHERE r = 1")
def mut_resolution_cache(spark, d):
    """A cache keyed by three columns: verdicts (here: traces) put over the older ones of the same key."""
    t = table(spark, d, "prompt_traces").select(F.col("prompt_name").alias("name"), "model", "article_uid", "id").distinct()
    old, new = t.where("id % 2 = 0"), t.where("id % 2 = 1")
    return L.put_cache(I.latest(old.withColumn("seq", F.col("id")), ["name", "model", "article_uid"], "seq").drop("seq"), new, ["name", "model", "article_uid"], "id")


@query("SELECT e.id AS entity_id, CASE WHEN e.id % 2 = 0 THEN e.name ELSE s.summary END AS summary, CASE WHEN s.entity_id IS NULL THEN 1 WHEN e.id % 2 = 0 THEN s.version + 1 ELSE s.version END AS version, CASE WHEN e.id % 2 = 0 THEN false ELSE s.stale END AS stale FROM {ent} e LEFT JOIN {syn} s ON s.entity_id = e.id WHERE s.entity_id IS NOT NULL OR e.id % 2 = 0")
def mut_synthesis_upsert(spark, d):
    """New syntheses (of every second entity): version 1, or the next one; no longer stale."""
    new = kb.entities(spark, d).where("id % 2 = 0").select(F.col("id").alias("entity_id"), F.col("name").alias("summary"))
    return L.upsert_syntheses(kb.syntheses(spark, d), new, ["summary"]).select("entity_id", "summary", F.col("version").cast("int").alias("version"), "stale")


@query("SELECT prompt_name, (max(prompt_version) + r)::BIGINT AS version, 'edit ' || r AS content FROM prompt_traces CROSS JOIN (VALUES (1), (2)) v(r) GROUP BY prompt_name, r")
def mut_prompt_version(spark, d):
    """Two edits of every prompt, numbered on."""
    h = table(spark, d, "prompt_traces").select("prompt_name", F.col("prompt_version").cast("long").alias("version"))
    edits = h.select("prompt_name").distinct().select("prompt_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    return I.next_versions(h, edits).select("prompt_name", F.col("version").cast("long").alias("version"), F.concat(F.lit("edit "), F.col("seq").cast("string")).alias("content"))


@query(f"SELECT a.uid, x.full_text IS NOT NULL AS replaced, CASE WHEN x.uid IS NOT NULL THEN false ELSE true END AS has_embeddings, coalesce(x.full_text, a.abstract_text) AS full_text FROM {{art}} a LEFT JOIN {_UPD} x ON x.uid = a.uid")
def mut_reextract(spark, d):
    """Text read again replaces the old one, and what was made of it is to be made anew."""
    x = table(spark, d, "extracted_text").groupBy("uid").agg(F.min("full_text").alias("full_text"))
    old = kb.articles(spark, d).select("uid", F.col("abstract_text").alias("full_text"), F.lit(True).alias("has_embeddings"), F.lit(True).alias("has_kg"))
    return L.reextracted(old, x).select("uid", "replaced", "has_embeddings", "full_text")


@query("SELECT 'articles' AS part, uid AS key FROM {art} WHERE workspace_id <> 1 OR workspace_id IS NULL UNION ALL SELECT 'chunks', id::VARCHAR FROM {chunk} WHERE article_uid NOT IN (SELECT uid FROM {art} WHERE workspace_id = 1) UNION ALL SELECT 'mentions', mention_id::VARCHAR FROM {ment} WHERE article_uid NOT IN (SELECT uid FROM {art} WHERE workspace_id = 1)")
def mut_delete_cascade(spark, d):
    """Articles of a workspace go, and with them their chunks and mentions."""
    a = kb.articles(spark, d)
    left = I.delete_cascade(a, {"chunks": kb.chunks(spark, d), "mentions": kb.mentions(spark, d)}, a.where("workspace_id = 1").select("uid"))
    key = {"articles": "uid", "chunks": "id", "mentions": "mention_id"}
    out = None
    for part, df in left.items():
        rows = df.select(F.lit(part).alias("part"), F.col(key[part]).cast("string").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT uid, coalesce(nullif(trim(abstract_text), ''), title) AS full_text, CASE WHEN coalesce(length(abstract_text), 0) > 0 THEN reg_date END AS evaluated_at FROM {art}")
def mut_migrations(spark, d):
    """Old rows with score columns brought to the present form: scores dropped into a backup, dates and texts filled in."""
    old = kb.articles(spark, d).select("uid", "title", "abstract_text", "reg_date", F.length("abstract_text").alias("score_a"), F.lit(None).cast("int").alias("score_b"))
    return L.migrate_scores(old, "score_")[0].select("uid", "full_text", "evaluated_at")


@query("SELECT id, id = (SELECT min(id) FROM workspaces WHERE name LIKE '%alert%') AS is_active FROM (SELECT DISTINCT id FROM workspaces)")
def mut_ws_active(spark, d):
    """One workspace is switched on, all others off."""
    w = table(spark, d, "workspaces")
    chosen = w.where(F.col("name").contains("alert")).agg(F.min("id").alias("chosen"))
    return L.activated(w.select("id").distinct(), chosen)


@query("SELECT uid, coalesce(workspace_id, (SELECT min(id) FROM workspaces)) AS workspace_id FROM (SELECT uid, CASE WHEN length(uid) % 3 = 0 THEN NULL ELSE workspace_id END AS workspace_id FROM {art})")
def ws_seed_backfill(spark, d):
    """Rows without a workspace go to the first one."""
    a = kb.articles(spark, d).select("uid", F.when(F.length("uid") % 3 != 0, F.col("workspace_id")).alias("workspace_id"))
    return L.backfill_workspace(a, table(spark, d, "workspaces").select("id"))


_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'workspace')"


@query(f"SELECT id, slug || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS slug, 'ws_' || slug || CASE WHEN r > 1 THEN '-' || r ELSE '' END || '.db' AS file, greatest(coalesce(lookback_days, 30), 1)::BIGINT AS lookback_days FROM (SELECT id, lookback_days, {_SLUG} AS slug, row_number() OVER (PARTITION BY {_SLUG} ORDER BY id) AS r FROM (SELECT id, min(coalesce(name, '')) AS name, min(lookback_days) AS lookback_days FROM workspaces GROUP BY id))")
def fn_slug_ws(spark, d):
    """Short names of workspaces, numbered where several have one."""
    w = table(spark, d, "workspaces").groupBy("id").agg(F.min(F.coalesce("name", F.lit(""))).alias("name"), F.min("lookback_days").alias("lookback_days"))
    return L.created_workspaces(w).select("id", "slug", "file", F.col("lookback_days").cast("long").alias("lookback_days"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'Renamed ' || id ELSE name END AS name, primary_question, CASE WHEN id % 2 = 0 THEN 14 ELSE lookback_days END::BIGINT AS lookback_days FROM (SELECT id, min(name) AS name, min(primary_question) AS primary_question, min(lookback_days) AS lookback_days FROM workspaces GROUP BY id)")
def ws_crud(spark, d):
    """Partial updates: what isn't given stays."""
    w = table(spark, d, "workspaces").groupBy("id").agg(*[F.min(c).alias(c) for c in ("name", "primary_question", "lookback_days")])
    new = w.where("id % 2 = 0").select("id", F.concat(F.lit("Renamed "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("primary_question"), F.lit(14).alias("lookback_days"))
    return L.partial_update(w, new, "id").select("id", "name", "primary_question", F.col("lookback_days").cast("long").alias("lookback_days"))


@query("SELECT uid, category, reg_date, title, first_author, authors, pub_date, journal, doi, url, abstract_text, content_type FROM {art}")
def prj_article_cols(spark, d):
    """The public columns of articles: never the full text."""
    a = kb.articles(spark, d).withColumn("full_text", F.col("abstract_text"))
    return L.public_columns(a).select("uid", "category", "reg_date", "title", "first_author", "authors", "pub_date", "journal", "doi", "url", "abstract_text", "content_type")


@query("SELECT uid, 'Corrected ' || coalesce(title, '') AS title, journal, doi FROM {art} WHERE length(uid) % 2 = 0 UNION ALL SELECT uid, title, journal, doi FROM {art} WHERE length(uid) % 2 = 1")
def prj_update_whitelist(spark, d):
    """Edits change editable fields only: one of the DOI and one of an unknown field are ignored."""
    a = kb.articles(spark, d).select("uid", "title", "journal", "doi")
    edits = a.where(F.length("uid") % 2 == 0).select("uid", F.map_from_arrays(F.array(F.lit("title"), F.lit("uid"), F.lit("no_such")), F.array(F.concat(F.lit("Corrected "), F.coalesce("title", F.lit(""))), F.lit("x"), F.lit("y"))).alias("changes"))
    return L.edited(a, edits)


@query("SELECT e.id, coalesce(e.mention_count, 0) + coalesce(m.n, 0) AS mention_count FROM {ent} e LEFT JOIN (SELECT entity_id AS id, count(*) AS n FROM {ment} GROUP BY 1) m USING (id)")
def agg_mention_count(spark, d):
    e = kb.entities(spark, d).withColumnRenamed("name", "canonical_name")
    m = kb.mentions(spark, d).join(e.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name")), "entity_id")
    return register_mentions(e, m).select("id", "mention_count")


@query("SELECT uid, uid IN (SELECT article_uid FROM {ment}) AS has_kg FROM {art}")
def kg_mark_done(spark, d):
    done = kb.mentions(spark, d).select(F.col("article_uid").alias("uid")).distinct()
    return L.marked(kb.articles(spark, d).select("uid"), done, "uid", "has_kg")


@query("SELECT uid FROM {art} WHERE nullif(trim(abstract_text), '') IS NOT NULL AND uid NOT IN (SELECT article_uid FROM {chunk}) ORDER BY reg_date DESC NULLS LAST, uid LIMIT 50")
def flt_backfill_candidates(spark, d):
    done = kb.chunks(spark, d).select(F.col("article_uid").alias("uid")).distinct()
    return L.backfill_candidates(kb.articles(spark, d).where(T.present(F.col("abstract_text")).isNotNull()), done, 50).select("uid")


@query("SELECT prompt_name, max(version)::BIGINT AS version, count(*) AS runs, coalesce(max(strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')), '') AS last_run, arg_max(id, (created_at, id)) AS last_id FROM (SELECT DISTINCT id, prompt_name, coalesce(prompt_version, 1) AS version, created_at FROM prompt_traces) GROUP BY 1")
def agg_prompt_stats(spark, d):
    return L.prompt_stats(table(spark, d, "prompt_traces").select("id", "prompt_name", "prompt_version", "created_at").distinct())


@query("SELECT v AS name, coalesce(t.runs, 0) AS runs, coalesce(t.version, 0)::BIGINT AS version FROM (VALUES ('entity_extraction'), ('never_run'), ('gap_finder')) x(v) LEFT JOIN (SELECT prompt_name, count(DISTINCT id) AS runs, max(coalesce(prompt_version, 1)) AS version FROM prompt_traces GROUP BY 1) t ON t.prompt_name = v")
def pr_list(spark, d):
    """Prompts there are, with what is known of their runs."""
    names = spark.createDataFrame([("entity_extraction",), ("never_run",), ("gap_finder",)], "name string")
    stats = L.prompt_stats(table(spark, d, "prompt_traces").select("id", "prompt_name", "prompt_version", "created_at").distinct())
    return names.join(stats.withColumnRenamed("prompt_name", "name"), "name", "left").select("name", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("version", F.lit(0)).cast("long").alias("version"))


@query("SELECT prompt_name, version, row_number() OVER (PARTITION BY prompt_name ORDER BY version DESC) AS position FROM (SELECT DISTINCT prompt_name, coalesce(prompt_version, 1)::BIGINT AS version FROM prompt_traces)")
def pr_versions(spark, d):
    from biblion.operators.retrieval import top_per

    v = table(spark, d, "prompt_traces").select("prompt_name", F.coalesce("prompt_version", F.lit(1)).cast("long").alias("version")).distinct()
    return top_per(v, ["prompt_name"], [F.desc("version")], 1 << 30).select("prompt_name", "version", F.col("rank").cast("long").alias("position"))


@query("SELECT 'never_run' AS prompt_name, 1::BIGINT AS version UNION ALL SELECT prompt_name, version FROM (SELECT DISTINCT prompt_name, coalesce(prompt_version, 1)::BIGINT AS version FROM prompt_traces)")
def pr_seed(spark, d):
    """Prompts without any version get their first."""
    v = table(spark, d, "prompt_traces").select("prompt_name", F.coalesce("prompt_version", F.lit(1)).cast("long").alias("version")).distinct()
    files = spark.createDataFrame([("entity_extraction",), ("never_run",)], "prompt_name string")
    return L.seeded_versions(v, files)
